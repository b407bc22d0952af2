"""Texts with very many matches: places across slices, and time in proportion."""

import random
import time

from flowsieve.llm import pii
from tests.llm import brute


def test_places_across_slices(spark, monkeypatch):
    rng = random.Random(2)
    cells = ["a@b.co", "10.0.3.1", "+49 170 1234567", "4111 1111 1111 1111", "é", "  ", "12 34", "x", "300.1.1.1", "日本", "@", "+1", "41111111111111111111111"]
    texts = ["".join(rng.choice(cells) + rng.choice([" ", ", ", "", "\n"]) for _ in range(n)) for n in (0, 1, 5, 40, 300, 900)]
    want = {i: (brute.digest(found), len(found)) for i, t in enumerate(texts) for found in [brute.pii_base(t)]}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for size in (1, 2, 256):
        monkeypatch.setattr(pii, "SLICE_MATCHES", size)
        got = {r.doc_id: (r.base_sha256, r.n_email + r.n_ip + r.n_card + r.n_phone) for r in pii.pii_digest(pii.find_pii(docs)).collect()}
        assert got == want


def test_time_is_linear_in_the_matches_of_a_text(spark):
    def seconds(n):
        docs = spark.createDataFrame([(1, " ".join(f"{i} 10.0.0.{i % 250} u{i}@b.org" for i in range(n)))], "doc_id int, text string")
        begun = time.time()
        row = pii.pii_digest(pii.find_pii(docs)).head()
        assert (row.n_ip, row.n_email) == (n, n)
        return time.time() - begun

    seconds(100)
    assert seconds(20_000) < 15 * seconds(2_000)
