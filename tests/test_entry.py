import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"s1_id", "matches"}


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", ["folders", "folders and pipeline", "a library"])
def test_imports_without_the_optional_part(tmp_path, gone):
    """The library and the entry work where the training-data folders, or a library that only they use, are missing."""
    (tmp_path / "tessera").mkdir()
    for p in (ROOT / "tessera").iterdir():
        if p.name != "__pycache__" and (p.name != "llm" or gone == "a library"):
            (tmp_path / "tessera" / p.name).symlink_to(p)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists() and (gone != "folders and pipeline" or name == "__spark_entry__.py"):
            (tmp_path / name).write_text((ROOT / name).read_text())
    block = "import sys; sys.modules['xxhash'] = None; " if gone == "a library" else ""
    code = f"{block}import __spark_entry__ as e; q = e.queries(); assert 'decide_dual' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)
