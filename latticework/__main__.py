import sys

from latticework.cli import main

sys.exit(main())
