import sys

from tidemark.client import main

sys.exit(main())
