"""A folder of token files stands alone; other tokenizers are asked for whole texts."""

from __future__ import annotations

import json
import os
import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortlab.llm import token_files
from llm_data import documents

DECODE = """
import json, sys
from cohortlab.llm.token_files import read_ids
from cohortlab.plans.session import local_session
spark = local_session(2)
print("rows " + json.dumps(sorted((r.start, r.doc_id, bytes(r.ids).hex()) for r in read_ids(spark, sys.argv[1]).collect())))
"""


def test_another_process_decodes_the_folder(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, 0, 10 * i, rng.integers(1, 4000, 10).astype("<u4").tobytes()) for i in range(50)]
    tokens = spark.createDataFrame(rows, "doc_id long, part long, first long, ids binary").coalesce(1)
    t = token_files.Table(token_files.count_ids(tokens))
    path = str(tmp_path / "files")
    token_files.write_ids(tokens, path, t)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    run = subprocess.run([sys.executable, "-c", DECODE, path], capture_output=True, text=True, timeout=200, env={**os.environ, "PYTHONPATH": root})
    out = [line for line in run.stdout.splitlines() if line.startswith("rows ")]
    assert out, run.stderr[-2000:]
    assert json.loads(out[0][5:]) == [[first, i, ids.hex()] for i, _, first, ids in rows]
    broken = spark.read.parquet(f"{path}/_table").collect()
    with pytest.raises(ValueError):
        token_files.Table.from_slots({r["id"]: r["slots"] + (r["id"] == broken[0]["id"]) for r in broken}, checksum=broken[0]["checksum"])


@pytest.mark.parametrize("name, by_word", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_ids_are_the_library_s_whatever_the_tokenizer(name, by_word):
    path = public_tokenizers.path(name)
    own, library = token_files.Ids(path), Tokenizer.from_file(path)
    assert own.by_word == by_word
    texts = [r[1] for r in documents()][:60]
    assert own.encode(texts) == [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
