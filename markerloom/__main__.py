import sys

from markerloom.cli import main

sys.exit(main())
