"""``python -m tabloom``."""

import sys

from tabloom.cli import main

sys.exit(main())
