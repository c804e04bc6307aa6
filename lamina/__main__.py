"""python -m lamina check|rewrite|bench ..."""

import sys

from lamina.cli import main

sys.exit(main())
