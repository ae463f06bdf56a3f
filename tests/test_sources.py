"""Ignore rules of file trees, and token counts by byte pairs."""

import base64

import pytest
from pyspark.sql import functions as F

from marlstone.functions import bpe
from marlstone.sources import files, ignores

CASES = [
    ("*.log\n", ["a.log", "x/b.log"], ["a.txt", "log"]),
    ("/build\n", ["build", "build/x"], ["x/build", "builds"]),
    ("build/\n", ["build/x", "a/build/y/z"], ["build", "a/build"]),
    ("doc/*.txt\n", ["doc/a.txt"], ["doc/x/a.txt", "x/doc/a.txt"]),
    ("**/foo\n", ["foo", "a/foo", "a/foo/b"], ["afoo"]),
    ("a/**/b\n", ["a/b", "a/x/b", "a/x/y/b/c"], ["b", "x/a/b"]),
    ("abc/**\n", ["abc/x", "abc/x/y"], ["abc"]),
    ("*.txt\n!keep.txt\n", ["a.txt", "x/b.txt"], ["keep.txt", "x/keep.txt"]),
    ("d/\n!d/keep\n", ["d/keep", "d/x"], ["e/keep"]),
    ("d/*\n!d/keep\n", ["d/x"], ["d/keep"]),
    ("\\#a\n\\!b\n# c\n\nc\\ \n", ["#a", "!b", "c "], ["a", "b", "c", "# c"]),
    ("f[0-9]?[!x]\n", ["f1ab"], ["fab", "f1ax", "f1a/"]),
    ("x  \n", ["x"], ["x  "]),
    ("foo**bar\n", ["fooxbar"], ["foo/bar"]),
]


@pytest.mark.parametrize("text, gone, kept", CASES)
def test_ignore_rules(spark, text, gone, kept):
    rules = spark.createDataFrame(ignores.rules_of("", text), ignores.RULES)
    paths = spark.createDataFrame([(p,) for p in [*gone, *kept, None, ""]], "file_path string")
    assert sorted(r.file_path for r in ignores.ignored(paths, rules).collect()) == sorted(gone)


def test_deeper_rules_come_last_and_scans_follow_them(spark, tmp_path):
    tree = {
        ".gitignore": "*.tmp\nout/\n", "a/.gitignore": "!keep.tmp\n/only.py\n", ".git/info/exclude": "secret.py\n*.keep\n", "a/b/.gitignore": "*.py\n!x.py\n",
        "x.tmp": "1", "a/keep.tmp": "2", "a/only.py": "3", "a/b/only.py": "4", "a/b/x.py": "5", "out/y.py": "6", "secret.py": "7", "z.py": "8", "a/b/c/x.py": "9",
    }
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = {r.file_path for r in files.scan(spark, str(tmp_path)).collect()}
    assert found == {"a/keep.tmp", "a/b/x.py", "z.py", "a/b/c/x.py"}
    assert {"x.tmp", "out/y.py"} <= {r.file_path for r in files.scan(spark, f"file://{tmp_path}", rules=False).collect()}
    assert {r.base for r in ignores.read_rules(spark, f"file://{tmp_path}").collect()} == {"", "a", "a/b"}


def merged(text, ranks):
    """Byte pairs of one part, merged by rank, the plain way."""
    parts = [bytes([b]) for b in text.encode()]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda k: ranks.get(parts[k] + parts[k + 1], 1 << 30))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return len(parts)


def test_byte_pair_counts(spark, tmp_path):
    import regex

    ranks = {bytes([b]): b for b in range(256)}
    for token in (b"th", b"he", b"the", b" the", b"in", b"ing", b"  ", b"an", b"and", b" and", b"\xc3\xa9", b"12", b"ll"):
        ranks[token] = len(ranks)
    path = tmp_path / "own.tiktoken"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {r}\n" for t, r in ranks.items()))
    texts = ["the thing and  the", "é12345 we'll\n\n  x", "", "a" * 300, "漢字 <|end|> the", None, "the and " * 50]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    known = bpe.read_ranks(spark, f"file://{path}")
    assert known == ranks
    got = {r.k: r.n for r in d.select("k", bpe.counter(spark, known)(F.col("text")).alias("n")).collect()}
    assert got == {k: None if t is None else sum(merged(p, ranks) for p in regex.findall(bpe.PATTERN, t)) for k, t in enumerate(texts)}
    special = bpe.counter(spark, known, special={"<|end|>": len(ranks)})
    assert d.filter("k = 4").select(special(F.col("text")).alias("n")).first().n == got[4] - merged(" <|", ranks) - merged("end", ranks) - merged("|>", ranks) + 1 + 1
    none = bpe.counter(spark, None)
    assert [r.n for r in d.filter("k IN (0, 2)").orderBy("k").select(none(F.col("text")).alias("n")).collect()] == [4, 0]


def test_long_texts_are_counted_in_parts(spark, monkeypatch):
    text = "word and\nword " * 50
    assert "".join(bpe.pieces(text)) == text
    monkeypatch.setattr(bpe, "PIECE", 20)
    assert "".join(bpe.pieces(text)) == text and max(map(len, bpe.pieces(text))) <= 21


def test_a_rank_file_that_is_too_large_is_refused(spark, tmp_path, monkeypatch):
    (tmp_path / "r").write_text("YQ== 0\n")
    monkeypatch.setattr(bpe, "MOST_BYTES", 3)
    with pytest.raises(ValueError, match="more than"):
        bpe.read_ranks(spark, f"file://{tmp_path}/r")
