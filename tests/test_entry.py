import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

from cairn.sources import tables

REPO = Path(__file__).resolve().parents[1]


def test_entry_works_without_the_optional_subpackage():
    code = "import sys; sys.modules['regex'] = None; sys.modules['cairn.llm'] = None; import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'p1_found' in q and 'p4_found' not in q and set(s) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


class _Cluster:
    class sparkContext:
        master = "spark://host:7077"

    class conf:
        @staticmethod
        def get(name, default):
            return default


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(ValueError):
        tables.shared_dir(_Cluster)


def test_text_files_and_release(spark):
    folder = tables.shared_dir(spark)
    assert tables.read_text(spark, f"{folder}/a") is None
    tables.write_text(spark, f"{folder}/a", "one")
    tables.write_text(spark, f"{folder}/a", "two")
    assert tables.read_text(spark, f"{folder}/a") == "two"
    tables.delete(spark, f"{folder}/a")
    assert tables.read_text(spark, f"{folder}/a") is None
    assert isinstance(spark, SparkSession)
