import sys

from envlattice.cli import main

sys.exit(main())
