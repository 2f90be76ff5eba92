import sys

from locusframe.cli import main

sys.exit(main())
