import sys

from contactweave.cli import main

sys.exit(main())
