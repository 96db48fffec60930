"""The README names every operator of the survey that isn't built."""

import re
from pathlib import Path

ROOT = Path(__file__).parents[1]
NAMES = "ingest_batch due_messages attach_posting attach_preferences owned_only drop_except child_counts usage_totals any_waiting split_failures newest_first build_payload hash_token prompt".split()


def test_missing_operators_are_listed():
    code = "\n".join(p.read_text() for p in (ROOT / "jobloom").rglob("*.py"))
    readme = (ROOT / "README.md").read_text()
    for name in NAMES:
        assert re.search(rf"^def {name}\b", code, re.M) or f"`{name}`" in readme, name
