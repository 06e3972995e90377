"""python -m seqmine, and what bin/seqmine submits."""

import sys

from seqmine.cli import main

if __name__ == "__main__":
    sys.exit(main())
