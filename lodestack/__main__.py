"""python -m lodestack: see lodestack.cli."""

from lodestack.cli import main

raise SystemExit(main())
