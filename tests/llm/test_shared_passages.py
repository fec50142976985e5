"""op2 counts passages of over 50 words that another document has, whatever bytes they take."""

from collections import defaultdict

import numpy as np

from quarry.llm import suffixes
from quarry.llm.catalog import QUERIES
from tests.conftest import SF_SMALL


def test_runs_of_51_words_are_counted_and_their_bytes_stay(spark):
    rng = np.random.default_rng(21)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefg"), 4)) for _ in range(n))
    passage, short = prose(51), prose(25)
    texts = [f"{prose(70)} {passage} {prose(9)}", f"{prose(3)}\n{passage}", f"{short} {prose(60)}", f"{prose(60)} {short}",
             prose(200), " ".join([prose(30)] * 3), "", None, passage.replace(" ", "  ")]
    out = suffixes.clean(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    got = {r["doc_id"]: (r["n_shared"] > 0, r["n_removed"] > 0) for r in out.where("doc_id < 9").collect()}
    assert {i for i, x in got.items() if x[0]} == {0, 1, 8}
    assert len(got) == 9 and not any(got[i][1] for i in (0, 1, 2, 3, 4, 6, 7, 8))


def test_op2_counts_all_documents_that_share_51_words(spark, tables):
    runs, half = defaultdict(set), defaultdict(set)
    for r in tables("documents"):
        words = (r["text"] or "").encode().translate(bytes.maketrans(b"\t\n\v\f\r", b"     ")).split(b" ")
        words = [w for w in words if w]
        for n, seen in ((51, runs), (26, half)):
            for p in range(len(words) - n + 1):
                seen[tuple(words[p:p + n])].add(r["doc_id"])
    runs, half = ({i for ids in x.values() if len(ids) > 1 for i in ids} for x in (runs, half))
    found = {r["doc_id"] for r in QUERIES["op2_suffix_dedup"](spark, SF_SMALL).where("n_shared > 0").collect()}
    assert runs and runs <= found <= half
