"""Repeated lines, edit fingerprints, url verdicts and shards against plain versions and odd input."""

import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from loadweave.llm import editsketch, linededup, sharding, urltree
from loadweave.llm.queries import QUERIES, URL_RULES


WORD = r"[\u3040-\u30ff\u4e00-\u9fff]|[^\s\u3040-\u30ff\u4e00-\u9fff]+"


def plain_units(text):
    """(start, end, words) of sentences within lines that have a word."""
    found, place = [], 0
    for line in text.split("\n"):
        for m in re.finditer(r"[^.!?…。！？]*[.!?…。！？]+|[^.!?…。！？]+", line):
            words = re.findall(WORD, m.group().strip(" .!?…。！？").lower())
            if words:
                part = m.group()
                found.append((place + m.start() + len(part) - len(part.lstrip()), place + m.start() + len(part.rstrip()), tuple(words)))
        place += len(line) + 1
    return found


def plain_dedup(rows, min_words):
    seen, found = set(), {}
    for key, text in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        listed, runs = plain_units(text), []
        known = []
        for _, _, words in listed:
            known.append(words in seen)
            seen.add(words)
        k = 0
        while k < len(listed):
            j = k
            while j < len(listed) and known[j]:
                j += 1
            if j > k and sum(len(w) for _, _, w in listed[k:j]) >= min_words:
                runs.append((listed[k][0], listed[j - 1][1]))
            k = max(j, k + 1)
        spans = []
        for a, z in runs:
            if text[:a][-1:] in ("", "\n") and text[z:][:1] in ("", "\n"):
                if z < len(text):
                    z += 1
                elif a > (spans[-1][1] if spans else 0):
                    a -= 1
            spans.append((a, z))
        found[key] = spans
    return found


def without(text, spans):
    for a, z in reversed(spans):
        text = text[:a] + text[z:]
    return text


def test_repeated_passages(spark):
    rng = random.Random(3)
    some = ["one two three four five.", "One  two, three four FIVE!", "a b.", "", "é é é é é é?", "x y z u v w", "版权所有。", "保留一切权利", "p q r s t.", "fin.", "..."]
    part = lambda n: "".join(rng.choice(some) + rng.choice([" ", "\n", "  ", "\n\n"]) for _ in range(n))
    passages = [part(9) for _ in range(4)]
    rows = [(i, f"new{i} words{i} here{i}. " + part(rng.randint(0, 3)) + rng.choice(["", rng.choice(passages)]) + f" tail{i}" * (i % 3)) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "\n".join(f"l{i % 700} b c d e" for i in range(3000))), (73, passages[0]), (74, passages[0] + passages[0])]
    docs = spark.createDataFrame([(*r, i, "n") for i, r in enumerate(rows)] + [(None, passages[0], 0, "n")], "doc_id long, text string, unit int, removed string")
    for least in (1, 12):
        found = linededup.remove_repeated_lines(docs, min_words=least)
        assert found.columns == ["doc_id", "text", "unit", "removed"]
        got = {r.doc_id: r for r in found.collect()}
        assert len(got) == len(rows) + 1
        assert got[None].text == passages[0] and got[None].removed == []
        assert got[70].text is None
        wanted = plain_dedup(rows, least)
        assert sum(map(bool, wanted.values())) > 20
        for key, text in rows:
            if text is not None:
                assert [tuple(s) for s in got[key].removed] == wanted[key]
                assert got[key].text == without(text, wanted[key])
    assert linededup.remove_repeated_lines(docs.limit(0)).count() == 0


def test_short_repeats_stay_unless_in_a_passage(spark, tmp_path):
    """A passage of 34 words in short sentences goes, glued to other text or not; a menu and a chance sentence stay."""
    passage = " ".join(f"Word{i} short{i}." for i in range(17))
    rows = [(1, f"Home\n\nAll rights reserved.\nall new here. {passage} more"), (2, f"home\n\nAll rights reserved.\nother. {passage} End here."), (3, f"Home\n{passage}\nlast"), (4, "文" * 40 + "。新"), (5, "文" * 40 + "。旧")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    wanted = {1: rows[0][1], 2: "home\n\nAll rights reserved.\nother.  End here.", 3: "last", 4: rows[3][1], 5: "旧"}
    assert {r.doc_id: r.text for r in QUERIES["op7_repeated_lines"].run(spark, str(tmp_path)).collect()} == wanted
    stage = corpus_pipeline.repeated_lines(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in stage} == wanted
    assert all(r.n_chars == len(r.text) for r in stage)


def test_rows_that_share_a_key_lose_only_their_own_lines(spark):
    x, y, z = ("a b c d " + c for c in "xyz")
    docs = spark.createDataFrame([(1, f"{x}\n{x}"), (1, f"{y}\n{z}"), (2, f"{z}\nnew")], "doc_id long, text string")
    found = sorted((r.doc_id, r.text) for r in linededup.remove_repeated_lines(docs, min_words=5).collect())
    assert found == [(1, x), (1, f"{y}\n{z}"), (2, "new")]


def plain_walk(text):
    """Step by step: write the character, move on if the bit is set."""
    classes = editsketch._char_class()
    bits = {}

    def bit(c, j):
        j %= editsketch.PERIOD
        if (c, j) not in bits:
            x = np.array([c * editsketch.PERIOD + j], np.uint64) + np.uint64(0xABCDEF)
            bits[c, j] = bool(editsketch.mix(x)[0] >> np.uint64(63))
        return bits[c, j]

    step, out = 0, []
    for ch in text:
        c = int(classes[ord(ch)])
        while True:
            out.append(c)
            step += 1
            if bit(c, step - 1):
                break
    return out


def test_fingerprints_sample_the_walk():
    rng = random.Random(1)
    texts = ["", "a", "héllo wörld", *["".join(rng.choice("abcde fghé") for _ in range(n)) for n in (130, 300, 900, 900)]]
    for text, found in zip(texts, editsketch.fingerprints(texts)):
        walk = plain_walk(text)
        level = int(found[:2])
        wanted = "".join("0123456789abcdef"[walk[p] & 15] for p in editsketch.places(level, len(walk)))
        assert found[2:] == wanted
        assert not walk or len(walk) <= editsketch.SAMPLES << level


def test_likeness_follows_edits():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghij klmnop") for _ in range(3000))
    # A shift by k characters is made good after about k * k steps.
    insert = text[:700] + "X" + text[700:1500] + text[1501:]
    other = "".join(rng.choice("abcdefghij klmnop") for _ in range(3000))
    a, b, c, d = editsketch.fingerprints([text, insert, other, text])
    assert editsketch.likeness(a, d) == 1.0
    assert editsketch.likeness(a, b) > 0.8 > 0.3 > editsketch.likeness(a, c)
    short, long_ = editsketch.fingerprints([text[:1700], text])
    assert 0.4 < editsketch.likeness(short, long_) < 0.7
    assert editsketch.likeness(*editsketch.fingerprints(["", ""])) == 1.0
    assert editsketch.likeness(*editsketch.fingerprints(["", "abc"])) == 0.0


def test_compare_with_next(spark):
    rng = random.Random(4)
    texts = [None, "", "é", "x" * 9, *["".join(rng.choice("ab cd") for _ in range(rng.randint(0, 400))) for _ in range(60)], "z" * 90_000]
    rows = [(3 * i, t, 1) for i, t in enumerate(texts)]
    shuffled = rng.sample(rows, len(rows))
    docs = spark.createDataFrame(shuffled, "doc_id long, text string, part int")
    found = {r.doc_id: r for r in editsketch.compare_with_next(docs).collect()}
    assert len(found) == len(rows)
    prints = editsketch.fingerprints([t or "" for t in texts])
    for i, (key, text, _) in enumerate(rows):
        text, after = text or "", texts[(i + 1) % len(texts)] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        r = found[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == prints[i]
        assert r.edited_fingerprint == editsketch.fingerprints([edited])[0]
        assert r.near_edited == editsketch.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == editsketch.likeness(prints[i], prints[(i + 1) % len(prints)])
    schema = "doc_id long, text string"
    assert editsketch.compare_with_next(spark.createDataFrame([], schema)).count() == 0
    one = editsketch.compare_with_next(spark.createDataFrame([(1, "abcd"), (None, None)], schema)).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in one) == [(0, 0), (1, 4)]
    frame = editsketch.fingerprint(docs).collect()
    assert {r.doc_id: r.fingerprint for r in frame} == {k: p for (k, _, _), p in zip(rows, prints)}


URLS = [
    "http://Example.COM/en/1", "https://www.example.com/en/2?x=/fr/", "http://a.net/es/", "http://net/fr/1#x", "http://annet/es/1", "http://a.com",
    "http://a.com/", "no scheme", "", None, "://", "x://h?q", "http://b.org//a//b/", "HTTP://ÄB.Example.com/en", "http://a.example.com/en/x://y/z", "a://b\n.com/x",
]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.fullmatch(r"(?s)([^/?#]*)([^?#]*).*", url.split("://", 1)[1]).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def test_rules(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)]
    pages = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, host string")
    found = urltree.judge(pages, URL_RULES).collect()
    assert len(found) == len(rows) + 1
    for r in found:
        host, path = plain_parts(URLS[r.page_id])
        rule = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.host + rule.path)
        assert r.verdict in ("allow", "block") and (rule is None or r.verdict == rule.verdict)
    assert urltree.judge(pages.limit(0), URL_RULES).count() == 0


def test_templates_learn_from_ruled_urls(spark):
    rules = [urltree.Rule("block", "h.org", f"/ads/{i}") for i in range(0, 60, 2)] + [urltree.Rule("allow", "h.org", f"/news/{i}") for i in range(0, 60, 2)]
    urls = [f"http://h.org/ads/{i}" for i in range(100)] + [f"http://h.org/news/{i}" for i in range(100)] + ["http://h.org/other/1", "http://i.org/ads/1"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    found = {urls[r.page_id]: r for r in urltree.judge(pages, rules).collect()}
    assert found["http://h.org/ads/99"].template == "/ads/{n}"
    assert {found[f"http://h.org/ads/{i}"].verdict for i in range(100)} == {"block"}
    assert {found[f"http://h.org/news/{i}"].verdict for i in range(100)} == {"allow"}
    assert found["http://h.org/other/1"].verdict == found["http://i.org/ads/1"].verdict == "allow"


def test_evidence_reaches_unruled_urls(spark):
    """Labelled siblings that agree decide for unlabelled ones; one alone or two that differ do not. Deep paths have levels of their own."""
    rules = [urltree.Rule("block", h, p) for h in ("x.org", "y.org", "z.org") for p in ("/es/", "/fr/") if (h, p) not in (("y.org", "/fr/"), ("z.org", "/fr/"))]
    rules += [urltree.Rule("allow", "y.org", "/fr/"), urltree.Rule("block", "d.org", "/a/b/c/d/e/ads/1"), urltree.Rule("allow", "d.org", "/a/b/c/d/e/news/1")]
    urls = [f"http://{h}.org/{s}/{i}" for h in "xyz" for s in ("es", "fr", "en") for i in range(10)]
    urls += [f"http://d.org/a/b/c/d/e/{s}/{i}" for s in ("ads", "news") for i in range(30)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    found = {urls[r.page_id]: r for r in urltree.judge(pages, rules).collect()}
    assert [found[f"http://{h}.org/en/3"].verdict for h in "xyz"] == ["block", "allow", "allow"]
    assert [found[f"http://{h}.org/en/3"].template for h in "xyz"] == ["/*/{n}", "/en/{n}", "/en/{n}"]
    assert found["http://d.org/a/b/c/d/e/ads/2"].verdict == "block" and found["http://d.org/a/b/c/d/e/news/2"].verdict == "allow"


def test_variable_segments_become_wildcards(spark):
    urls = [f"http://h.org/user-{c}x{i}/home" for i, c in enumerate("abcdefghijklmnopqrstuvwxyz" * 2)] + ["http://h.org/a1b2c3d4e5/x"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    templates = {r.template for r in urltree.judge(pages, URL_RULES).collect()}
    assert templates == {"/*/home", "/*/x"}


@pytest.mark.parametrize("bucket_bytes", [200, 1 << 20])
def test_shards(spark, bucket_bytes):
    rng = random.Random(7)
    rows = [(i, "t" * rng.randint(0, 90), i) for i in range(400)] + [(None, None, 0), (5, None, 0), (7, "same", 0), (7, "same", 0), (8, "x" * 50_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    found = sharding.external_shuffle(docs, 16, bucket_bytes=bucket_bytes).collect()
    assert sorted(((r.doc_id is None, r.doc_id, r.text or "") for r in found), key=str) == sorted(((k is None, k, t or "") for k, t, _ in rows), key=str)
    sizes = np.bincount([r.shard for r in found], minlength=16)
    assert sizes.max() - sizes.min() <= 1
    for s in range(16):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sizes[s]))
    again = sharding.external_shuffle(docs.repartition(3), 16, bucket_bytes=bucket_bytes).collect()
    place = lambda rows: sorted((r.shard, r.slot, r.doc_id or -1, r.text or "") for r in rows)
    assert place(found) == place(again)
    order = [r.doc_id for r in sorted(found, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    assert abs(np.corrcoef(np.arange(len(order)), order)[0, 1]) < 0.2
    assert sharding.external_shuffle(docs.limit(0), 16).count() == 0


def test_shards_on_disk(spark, tmp_path):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    shuffled = sharding.external_shuffle(docs, 4)
    sharding.write_shards(shuffled, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.groupBy("shard").count().orderBy("shard").collect() == [(i, 25) for i in range(4)]


def test_fisher_yates_is_uniform_and_repeatable():
    assert sharding.fisher_yates(50, (1, 2)).tolist() == sharding.fisher_yates(50, (1, 2)).tolist()
    firsts = np.bincount([sharding.fisher_yates(5, (1, s))[0] for s in range(5000)], minlength=5)
    assert abs(firsts - 1000).max() < 130


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j - 1] + (x != y), before[j] + 1, row[-1] + 1))
    return row[-1]


def edited(rng, text, edits):
    for _ in range(edits):
        at = rng.randrange(len(text) + 1)
        text = rng.choice([text[:at] + "q" + text[at:], text[:at] + text[at + 1 :], text[:at] + "z" + text[at + 1 :]])
    return text


def test_edit_distance():
    rng = random.Random(8)
    for _ in range(200):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 12)))
        b = rng.choice([edited(rng, a, rng.randint(0, 4)), "".join(rng.choice("abé") for _ in range(rng.randint(0, 12)))])
        most = rng.randint(0, 12)
        wanted = plain_distance(a, b)
        assert editsketch.edit_distance(a, b, most) == (wanted if wanted <= most else None)


def test_near_texts(spark):
    rng = random.Random(10)
    bases = ["".join(rng.choice("abcdefgh ijklmnop") for _ in range(n)) for n in (60, 150, 400, 900, 1500) for _ in range(4)]
    texts = [t for b in bases for t in (b, edited(rng, b, max(1, len(b) // 60)), edited(rng, b, 1), b)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.query, r.match): r.distance for r in editsketch.near_texts(docs.filter("doc_id % 2 = 0"), docs).collect()}
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    wanted = {}
    asked = {}
    for i in range(0, len(texts), 2):
        if texts[i] is not None:
            asked.setdefault(texts[i], i)
    for a, i in asked.items():
        for b, j in first.items():
            if b is not None and a != b and abs(len(a) - len(b)) <= 0.1 * max(len(a), len(b)):
                d = editsketch.edit_distance(a, b, int(0.1 * max(len(a), len(b))))
                if d is not None:
                    wanted[i, j] = d
    assert found.items() <= wanted.items()
    assert len(found) >= 0.9 * len(wanted) > 40


@pytest.mark.parametrize("size", [100, 800, 3000, 12000])
@pytest.mark.parametrize("share", [0.05, 0.09])
def test_edited_texts_are_candidates(size, share):
    """Texts of every length and share of edits share a band of pieces; unlike ones hardly ever do."""
    rng = random.Random(size)
    bases = ["".join(rng.choice("abcdefgh ijklmnop") for _ in range(size)) for _ in range(20)]
    keys = [set(editsketch.piece_keys(b)) for b in bases]
    near = [bool(k & set(editsketch.piece_keys(edited(rng, b, int(share * size))))) for b, k in zip(bases, keys)]
    print(size, share, np.mean(near))
    assert np.mean(near) >= 0.9
    assert sum(bool(a & b) for a, b in zip(keys, keys[1:])) <= 1


def test_near_texts_finds_long_texts_with_many_edits(spark):
    rng = random.Random(12)
    bases = ["".join(rng.choice("abcdefgh ijklmnop") for _ in range(3000)) for _ in range(12)]
    texts = [t for b in bases for t in (b, edited(rng, b, 270))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = editsketch.near_texts(docs.filter("doc_id % 2 = 0"), docs).collect()
    assert sum(r.match == r.query + 1 for r in found) >= 11
