"""Run the command line."""

import sys

from arbiter.cli import main

sys.exit(main())
