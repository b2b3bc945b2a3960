import subprocess
import sys
from pathlib import Path


def test_no_session_needed():
    """The queries can be listed before there is a session."""
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True)
