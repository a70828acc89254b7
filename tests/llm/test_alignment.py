import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from paperloom.llm import alignment

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["x" * 50_000, " " * 300_000, "a" + "\n" * 10_000 + "b", "日本語テキスト 🙂 é", "<|endoftext|> <s> </s> <0x41>", "tab\there  two", "▁ odd", "é ﬁ  x", "", None, "\x00\x01", " lead", "trail ", "😀" * 500]


class Plain:
    """Tokens of both sides with their bytes, and a walk over the two, token by token."""

    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def __call__(self, text):
        if not text:
            return None
        whole = (" " + text).encode()
        got = self.a.encode(" " + text, add_special_tokens=False)
        ends = [e for _, e in got.offsets]
        b = [(i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()) for i in self.b.encode(text) for p in [self.b.id_to_piece(i)]]
        letters = self._letters()
        a = [(i, bytes(letters[c] for c in self.a.id_to_token(i))) for i in got.ids]
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole or not ends:
            return None
        i = j = 0
        at_a, at_b, links, groups, ga, gb = len(a[0][1]), len(b[0][1]), [], [], [a[0][0]], [b[0][0]]
        while True:
            links.append((a[i][0], b[j][0]))
            at = min(at_a, at_b)
            if at_a == at_b:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                ga, gb = [], []
            if at == len(whole):
                return len(a), len(b), groups, links
            if on := at_a == at:
                i += 1
                ga.append(a[i][0])
            if at_b == at:
                j += 1
                at_b += len(b[j][1])
                gb.append(b[j][0])
            at_a += len(a[i][1]) if on else 0

    @staticmethod
    def _letters():
        out, n = {}, 0
        for x in range(256):
            if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174:
                out[chr(x)] = x
            else:
                out[chr(256 + n)], n = x, n + 1
        return out


@pytest.fixture(scope="module")
def rows(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    return docs + [(10**6 + i, x) for i, x in enumerate(ODD)]


@pytest.fixture(scope="module")
def want(rows):
    plain = Plain()
    found = {d: plain(t) for d, t in rows}
    counts, best = Counter(x for v in found.values() if v for x in v[3]), {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return {d: (0, 0, 0, 0, 0, 0, "") if v is None else (v[0], v[1], len(v[2]), len(v[3]), sum(counts[x] == best[x[1]] for x in v[3]), sum(counts[x] for x in v[3]), hashlib.sha256(";".join(v[2]).encode()).hexdigest()) for d, v in found.items()}


def test_equals_a_plain_walk(spark, rows, want):
    out = alignment.tokenizer_alignment(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.columns == COLUMNS and {r[0]: tuple(r[1:]) for r in out.collect()} == want


def test_hot_side_ids_are_dealt(spark, rows, want, monkeypatch):
    """Side ids over many parts, sums passed on early, small chunks: the same rows."""
    for name, value in (("TOGETHER", 50), ("HELD", 40), ("CHUNK", 20_000)):
        monkeypatch.setattr(alignment, name, value)
    out = alignment.tokenizer_alignment(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == want


def test_query_is_the_operator_on_documents(spark, rows):
    got = {r["doc_id"]: r["groups_sha256"] for r in alignment.QUERIES["op11_tokenizer_alignment"](spark, SF).collect()}
    alone = alignment.tokenizer_alignment(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert len(got) == 200 and got == {r["doc_id"]: r["groups_sha256"] for r in alone}
