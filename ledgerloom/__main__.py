"""python -m ledgerloom --manifest ... [--config ...] [--out ...] [--explain]"""

import sys

from ledgerloom.plans.runner import main

sys.exit(main())
