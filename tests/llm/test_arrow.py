import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[2]
CHILD = """
import re
import pyarrow as pa
from kindred.llm import arrow

def anon():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def run(batches):
    for batch in batches:
        held = [str(x) * 40 for x in range(300_000)]
        yield pa.RecordBatch.from_arrays([pa.array(held)], ["text"])
        del held

wrapped = arrow.giving_back(run) if GIVE else run
one = pa.RecordBatch.from_arrays([pa.array(["a"])], ["text"])
before = anon()
assert sum(b.num_rows for b in wrapped(iter([one, one]))) == 600_000
print(anon() - before)
"""


def kept(give: bool) -> float:
    said = subprocess.run([sys.executable, "-c", CHILD.replace("GIVE", str(give))], cwd=ROOT, capture_output=True, text=True, check=True, timeout=120)
    return float(said.stdout)


def test_a_worker_gives_memory_back():
    with_it, without = kept(True), kept(False)
    assert with_it < 40 and with_it < without / 2
