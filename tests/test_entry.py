import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent
CODE = "import sys; {before}; import __spark_entry__ as e; from tessera import plans; assert set(e.queries()) == set(plans.QUERIES) and e.oracle_sql() == plans.SQL"


def run(before: str) -> None:
    subprocess.run([sys.executable, "-c", CODE.format(before=before)], cwd=ROOT, check=True, timeout=120)


def test_operators_that_cannot_be_imported_are_left_out():
    run("sys.modules['zstandard'] = None")
    run("sys.modules['xxhash'] = None")


def test_the_library_stands_without_its_training_data_part():
    run("sys.modules['tessera.llm'] = None")
    run("sys.modules['tessera.llm'] = sys.modules['corpus_pipeline'] = None")
