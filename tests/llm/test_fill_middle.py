import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm.fill_middle import BlockTree, draws, fill_in_middle, fill_in_middle_digest, restored_text, transform

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    if h[3] % 100 < 80:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def random_text(rng):
    parts = ["a", "word", "naïve", "日本語", "😀", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c", "\x1f", "\xa0", "<", "<P", "S>", "M>", "\x00"]
    return "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 5, 30, 400])))


@pytest.mark.parametrize("block", [1, 2, 3, 7, 512])
def test_every_boundary(block):
    rng = random.Random(block)
    for _ in range(60):
        text = random_text(rng)
        units = UNIT.findall(text)
        tree = BlockTree(text.encode(), block, block * 3)
        assert (tree.units, tree.chars) == (len(units), len(text))
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert tree.locate(k) == (len(head.encode()), len(head))


def test_nodes_hold_sums_of_their_ranges():
    data = ("one two  three é " * 50).encode()
    tree, leaves = BlockTree(data, 4), []
    for at in range(0, len(data), 4):
        head = BlockTree(data[:at + 4], 4)
        leaves.append(sum(1 for c in data[at:at + 4] if c & 0xC0 != 0x80))
        assert head.chars == sum(leaves)
    for i in range(1, len(leaves) + 1):
        assert tree.sums[i, 1] == sum(leaves[i - (i & -i):i])


def test_query_equals_plain_version(spark, make_docs, odd_rows):
    rng = random.Random(1)
    rows = odd_rows + [(100 + i, random_text(rng)) for i in range(300)] + [(900, "x <P> y"), (901, "<M>"), (902, "<S"), (-5, "minus five words here now")]
    got = fill_in_middle(make_docs(rows, extra=True)).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    want = [(i, *plain_version(i, t)) for i, t, *_ in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    sha = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    digests = fill_in_middle_digest(make_docs(rows, extra=True)).collect()
    assert sorted(map(tuple, digests), key=key) == sorted([(*w[:5], sha(w[5]), sha(r[1])) for w, r in zip(want, rows)], key=key)
    assert fill_in_middle(make_docs([])).collect() == []


def test_pieces_next_to_markers(spark):
    for numbers in ([1, 2, 0, 0], [1, 2, 0, 99], [0, 3, 0, 0], [2, 2, 0, 99]):
        for text in ("a< S> M>b", "<S <P <M", "> < >", "<< S>> <"):
            n, form, _, _, output = transform(text.encode(), numbers, 50, 80, ("<P>", "<S>", "<M>"))
            row = spark.createDataFrame([(output.decode(), form)], "o string, f string")
            assert row.select(restored_text(F.col("o"), F.col("f"))).first()[0] == text


def test_shares_and_markers(make_docs):
    forms = [transform(b"a b c", draws(42, i), 50, 80, ("<P>", "<S>", "<M>"))[1] for i in range(4000)]
    assert abs(forms.count("plain") / 4000 - 0.5) < 0.03 and abs(forms.count("spm") / 4000 - 0.4) < 0.03
    got = fill_in_middle(make_docs([(i, "one two three") for i in range(40)]), percent=100, spm_percent=0, markers=("[pre]", "[suf]", "[mid]"))
    assert all(r.form == "psm" and r.output.startswith("[pre]") for r in got.collect())
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "S<", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle(make_docs([]), markers=bad)


def test_long_text_in_chunks():
    rng = np.random.default_rng(2)
    text = " ".join(rng.choice(["alpha", "β", "gamma delta"], 300_000))
    units = UNIT.findall(text)
    tree = BlockTree(text.encode())
    for k in (1, 17, len(units) // 2, len(units) - 1, len(units)):
        assert tree.locate(k) == (len("".join(units[:k]).encode()), len("".join(units[:k])))
