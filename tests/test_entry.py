"""The entry without the training-data subpackage: its folders are gone, or a
package that it needs is not installed. The league queries stay."""

import os
import shutil
import subprocess
import sys
import textwrap

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"

PROBE = textwrap.dedent("""
    import sys
    sys.path.insert(0, {root!r})
    {before}
    import __spark_entry__ as entry
    queries, oracles = entry.queries(), entry.oracle_sql()
    from pitchside.plans.queries import REGISTRY
    assert len(REGISTRY) > 50 and set(REGISTRY) <= set(queries) and set(REGISTRY) <= set(oracles)
    assert {whole} or set(queries) == set(REGISTRY) == set(oracles), sorted(set(queries) - set(REGISTRY))
    if {run!r}:
        from pitchside.session import local_session
        spark = local_session(2)
        for name in {run!r}:
            assert queries[name](spark, {sf!r}).count() > 0
    print("whole")
""")


def probe(root, before="", run=(), whole=False):
    done = subprocess.run([sys.executable, "-c", PROBE.format(root=root, before=before, run=tuple(run), sf=SF, whole=whole)], cwd=root,
                          capture_output=True, text=True, timeout=600, env=os.environ | {"PYTHONPATH": ""})
    assert done.stdout.strip().endswith("whole"), done.stderr[-2000:]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
@pytest.mark.parametrize("with_pipeline", [True, False])
def test_without_the_folders(tmp_path, with_pipeline):
    root = str(tmp_path / "copy")
    shutil.copytree(REPO, root, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache",
                                                              *([] if with_pipeline else ["corpus_pipeline.py"])))
    probe(root, run=["standings", "latest_season"] if with_pipeline else [])


@pytest.mark.parametrize("package", ["tiktoken", "public_tokenizers", "xxhash"])
def test_without_a_package(package):
    # a name that is None in sys.modules cannot be imported; what imports it only
    # when it runs may stay registered
    probe(REPO, before=f"sys.modules[{package!r}] = None", whole=package == "tiktoken")
