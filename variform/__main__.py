import sys

from variform.commands import main

sys.exit(main())
