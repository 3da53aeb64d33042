import sys

from xylem.cli import main

sys.exit(main())
