"""The driver's contract, with and without what the text-corpus operators need."""

import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)
CODE = """
import sys
sys.path.insert(0, {root!r})
for name in {missing!r}:
    sys.modules[name] = None
import __spark_entry__ as e
q, s = e.queries(), e.oracle_sql()
assert set(s) <= set(q), set(s) - set(q)
print(len(q), sum(k.startswith("op") for k in q), "pipeline" in q)
"""


def counts(*missing):
    out = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT, missing=list(missing))], capture_output=True, text=True, check=True, timeout=120)
    n, ops, pipeline = out.stdout.split()
    return int(n), int(ops), pipeline == "True"


def test_engine_queries_stay_without_the_operators():
    whole = counts()
    bare = counts("lensmark.llm")
    assert bare[1:] == (0, False) and bare[0] == whole[0] - whole[1] - whole[2]
    for needed in ("tiktoken", "zstandard", "public_tokenizers"):
        assert counts(needed)[0] >= bare[0]
