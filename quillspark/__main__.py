"""``python -m quillspark``; see quillspark.cli."""

import sys

from quillspark.cli import main

sys.exit(main())
