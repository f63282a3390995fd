import sys

from .plans.service import main

sys.exit(main())
