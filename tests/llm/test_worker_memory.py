"""Memory that a Python worker, which is kept from task to task, still has after one."""

import subprocess
import sys

TASKS = """
import re
import numpy as np, pyarrow as pa
from hindcast.llm import common, words

def anonymous():
    return int(re.search(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10

def task(texts):
    for part in common.chunks(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]), "text"):
        data, at = common.text_buffers(part.column(0))
        starts, ends, doc = words.spans(words.LOWER[data], at, words.ALNUM)
        words.shingles(words.hashes(data, starts, ends), doc, 5)

task(["a b"])
before = anonymous()
task(["some words of a text " * 100] * 10_000)  # 21 MB
task(["some words of a text " * 800_000])  # one text of 17 MB
task(["a b"])
print(anonymous() - before)
"""


def test_a_worker_gives_back_what_a_task_took():
    left = int(subprocess.run([sys.executable, "-c", TASKS], capture_output=True, text=True, check=True).stdout)
    assert left < 60
