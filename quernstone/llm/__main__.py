"""The command line over the queries of this subpackage: ``python -m quernstone.llm list``."""

from __future__ import annotations

import sys

from quernstone.__main__ import main
from quernstone.llm import catalog

if __name__ == "__main__":
    sys.exit(main(queries=catalog.QUERIES))
