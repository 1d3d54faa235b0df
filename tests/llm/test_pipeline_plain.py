"""The whole pipeline against plain versions of its stages, one after the other, on whole tables."""

import hashlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from spindrift.llm import line_dedup, quality_knn, queries
from spindrift.llm.common import fold

from .test_llm_operators import brute_fp, brute_hits


def plain_votes(spark, d, texts):
    """Votes by all cosines with every labelled vector; the space itself is the stage's."""
    space = quality_knn.fit(queries.read(spark, d, "documents"), queries.read(spark, d, "labels"), "quality", fold("doc_id", 5) != 0)
    v = np.stack([space._unit(space._weighed(quality_knn.term_counts([t])) @ space.project)[0] for t in texts])
    out = []
    for own in v @ space.vectors.T:
        rounded = np.rint(own * 1e9)
        top = sorted(range(len(own)), key=lambda i: (-rounded[i], i))[: quality_knn.NEIGHBOURS]
        w = np.exp(20 * (rounded[top] / 1e9 - 1))
        out.append((float((w * space.labels[top]).sum()) + 1e-6 * space.prior) / (float(w.sum()) + 1e-6))
    return out


def plain_lines(docs):
    documents = docs  # noqa: F841  read by name
    got = duckdb.sql(line_dedup.SQL).df().set_index("doc_id")["text"]
    return docs.assign(text=[got[i] for i in docs["doc_id"]])


def plain_groups(docs):
    """The least id of each group of fingerprints that are linked by all pairs."""
    codes = [brute_fp(t) for t in docs["text"]]
    ids = docs["doc_id"].tolist()
    near = defaultdict(list)
    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= 4:
                near[i].append(j)
                near[j].append(i)
    least, todo = {}, sorted(range(len(ids)), key=lambda i: ids[i])
    for start in todo:
        if start not in least:
            stack = [start]
            while stack:
                i = stack.pop()
                if i not in least:
                    least[i] = ids[start]
                    stack += near[i]
    return {ids[i] for i in range(len(ids)) if least[i] == ids[i]}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_run_against_plain_stages(spark, sf):
    from tokenizers import Tokenizer

    d = f"/root/testdata/{sf}"
    docs = pd.read_parquet(f"{d}/documents.parquet").sort_values("doc_id").reset_index(drop=True)
    docs = docs[np.array(plain_votes(spark, d, docs["text"].tolist())) >= corpus_pipeline.QUALITY]
    docs = plain_lines(docs)
    docs = docs[docs["doc_id"].isin(plain_groups(docs))]
    items = [(r.item_id, r.text) for r in pd.read_parquet(f"{d}/benchmark.parquet").itertuples()]
    docs = docs[[brute_hits(t, items)[1] == 0 for t in docs["text"]]]
    own, want = Tokenizer.from_file(queries.tokenizer_path(spark)), set()
    for r in docs.itertuples():
        ids = own.encode(r.text, add_special_tokens=False).ids
        back = own.decode(ids, skip_special_tokens=False)
        want.add((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, d).collect()
    assert len(got) == len(want) > 50 and set(map(tuple, got)) == want
