"""Chat, mixing, line dedup, pseudonyms and page text on small cases with defined results."""

import hashlib
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import chat, html_text, line_dedup, mixing, pii

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size long, score double"


def docs(spark, rows):
    """Documents with extra columns whose names clash with those that operators add."""
    return spark.createDataFrame([(i, t, "en", s, None, "x", 7, 0.1) for i, t, s in rows], DOCS)


# ---- line dedup

def plain_line_dedup(texts, least):
    key = lambda line: re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    seen = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    return sorted("\n".join(x for x in (t or "").split("\n") if seen[key(x)] < least or not key(x)) for t in texts)


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(3)
    lines = ["Common line", " common LINE\t", "É unit", "é unit", "", "  ", "rare 1", "rare 2", "x" * 5000]
    texts = ["\n".join(rng.choices(lines, k=rng.randint(0, 9))) for _ in range(60)] + [None, "", "\n\n", "a\n" * 3000 + "Common line"]
    texts += ["Common line\nsame text"] * 5
    got = line_dedup.drop_frequent_lines(docs(spark, [(i % 50, t, "s") for i, t in enumerate(texts)]), min_docs=10)
    assert sorted(r.kept for r in got.collect()) == plain_line_dedup(texts, 10)
    assert {"size", "score", "lang"} <= set(got.columns)


def test_line_dedup_counts_rows_not_ids_and_keeps_null_ids(spark):
    got = line_dedup.drop_frequent_lines(docs(spark, [(None, "Line", None)] * 3 + [(1, "other", None)]), min_docs=3).collect()
    assert sorted((r.kept, r.n_lines, r.n_dropped) for r in got) == [("", 1, 1)] * 3 + [("other", 1, 0)]


def test_line_dedup_of_nothing(spark):
    assert line_dedup.drop_frequent_lines(docs(spark, [])).count() == 0


# ---- mixing

def plain_targets(sizes, weights, most):
    """Share by weight, stop at the limit, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = sum(sizes.values())
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] > most * sizes[s] * total}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over


@pytest.mark.parametrize("seed", range(3))
def test_mix_matches_plain_targets(spark, seed):
    rng = random.Random(seed)
    names = ["b", "a", "é", "Z", None, "tiny"]
    rows = [(i, "w " * rng.randint(0, 30), "a" if rng.random() < 0.4 else rng.choice(names)) for i in range(300)]
    rows = [(i, t, s) for i, t, s in rows if s != "tiny" or i < 40] + [(5, None, "b"), (5, None, "b"), (None, "q q", None)]
    got = mixing.mix_sources(docs(spark, rows), rows_per_bucket=25).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes, [1, 2, 3], 3)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix_sources(docs(spark, rows).repartition(5), rows_per_bucket=25).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_of_empty_texts_and_of_nothing(spark):
    got = mixing.mix_sources(docs(spark, [(1, None, None), (2, "", "a")])).collect()
    assert [(r.taken, r.target) for r in got] == [(0, 0.0)] * 2
    assert mixing.mix_sources(docs(spark, [])).count() == 0


# ---- chat

TEXTS = ["plain", "", None, "</s>[INST] ok [/INST]", "[\\INST] <\\s>", "<", "[", "[/INST", "a\nb\\n", "<s><s>", "[\\\\/INST]", "x" * 20000]


def test_chat_round_trip(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a\\nb", "new\nline", "[INST]", "\\"]), rng.choice(TEXTS), 0)
            for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(None, None, "user", "null ids", 0), (None, 1, "user", "tie", 0), (None, 1, "user", "tie", 0)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int"))
    by_conv = {}
    for c, t, role, text, _ in rows:
        by_conv.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    for r in got.collect():
        assert [(t.role, t.text) for t in r.turns] == [x[2:] for x in sorted(by_conv.pop(r.conv_id))]
        assert r.formatted.count("[INST]") + r.formatted.count("<s>") == len(r.turns)
    assert not by_conv


def test_loss_mask_covers_each_assistant_text_once(spark, monkeypatch):
    monkeypatch.setattr(chat, "RUN", 3)
    texts = ["", "plain", "</s>[INST] ok [/INST]", "héllo 😀\n", r"<\s> [\\INST]", "end"]
    rows = [(1, i, "assistant" if i % 3 else "user", t) for i, t in enumerate(texts * 5)]
    rows += [(2, 0, "user", "only asks"), (3, 0, "assistant", "only answers"), (4, 0, None, None)]
    done = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = done.withColumn("loss", chat.under_mask(F.col("formatted"), F.col("mask"))).collect()
    for r in got:
        wanted = [t for c, _, role, t in rows if c == r["conv_id"] and role == "assistant"]
        assert r["loss"] == wanted
        raw = r["formatted"].encode()
        covered = [(s["start"], s["start"] + s["length"]) for s in r["mask"]]
        assert all(a[1] + 7 <= b[0] for a, b in zip(covered, covered[1:]))
        assert all(raw[a - 3 : a] == b"<s>" and raw[b : b + 4] == b"</s>" for a, b in covered)


def test_chat_of_nothing(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- pseudonyms

def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def masked(spark, texts, key="k"):
    rows = pii.pseudonymise(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), key).orderBy("doc_id").collect()
    return [r.masked for r in rows], [[f.kind for f in r.found] for r in rows]


def test_pseudonyms_keep_formats_and_links(spark):
    texts = [
        "call +1 (017) 555-7713 or (017) 555-7713", "4111 1111 1111 1111", "4111111111111111 9807915762804490!!",
        "1987-03-12 and 12.03.1987", "ip 108.51.216.133 not 999.1.1.1", 'token = "b44e15e09fd311c3cf3163b66d5a9875"',
        "mail jo.81@mail6.example.com.", "DE89370400440532013000 DE89370400440532013001", "078-05-1120", "1999-13-45 v2.0.1 12345",
        None, "", "none",
    ]
    got, kinds = masked(spark, texts)
    phones = re.findall(r"\(\d{3}\) \d{3}-\d{4}", got[0])
    assert phones[0] == phones[1] != "(017) 555-7713" and got[0].startswith("call +1 (")
    card = got[1].replace(" ", "")
    assert luhn(card) == 0 and got[2].startswith(card + " ") and luhn("9807915762804490") == luhn(got[2].split()[1][:16])
    year, month, day = re.match(r"(\d{4})-(\d\d)-(\d\d) and ", got[3]).groups()
    assert got[3].endswith(f"{day}.{month}.{year}") and "1987-03-12" not in got[3]
    assert all(int(o) < 256 for o in re.search(r"ip (\S+)", got[4])[1].split(".")) and got[4].endswith("999.1.1.1")
    assert re.fullmatch(r'token = "[0-9a-f]{32}"', got[5]) and "b44e" not in got[5]
    assert "jo.81" not in got[6] and "@mail6.example.com" in got[6]
    iban = got[7].split()[0]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert got[7].split()[1] == "DE89370400440532013001"
    assert kinds[8] == ["ssn"] and got[9:] == texts[9:] and kinds[9:] == [[]] * 4


def test_iban_ends_where_its_country_ends(spark):
    spain, poland, card = "ES91 2100 0418 4502 0005 1332", "PL61 1090 1014 0000 0712 1981 2874", "4111 1111 1111 1111"
    texts = [f"{spain} BIC CAIXESBB", f"{spain} {poland} IBAN", f"BE12 {spain} X", f"AB12 {card}", f"BE12 {card} END", card, 'secret = "AB12CDEF34567890"']
    got, kinds = masked(spark, texts)
    assert kinds == [["iban"], ["iban", "iban"], ["iban"], ["number"], ["number"], ["number"], ["secret"]]
    assert got[0].endswith(" BIC CAIXESBB") and got[1].endswith(" IBAN") and got[2] == f"BE12 {got[0][:29]} X" and got[1][:29] == got[0][:29]
    assert not any(x in g for g in got for x in (spain[5:], poland[5:], card))
    assert got[3] == f"AB12 {got[5]}" and got[4] == f"BE12 {got[5]} END"
    for iban in (got[0][:29], got[1][30:64]):
        plain = iban.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def test_permutations_are_one_to_one(spark):
    three = [f"{n:03d}" for n in range(1000)]
    rows = spark.createDataFrame([(d,) for d in three], "d string")
    got = [r[0] for r in rows.select(pii.permute_digits(F.col("d"), "key", "t")).collect()]
    assert sorted(got) == three and got != three
    days = [f"20{y:02d}-0{m}-1{d}" for y in range(40) for m in range(1, 10) for d in range(3)]
    out, _ = masked(spark, days)
    assert len(set(out)) == len(days) and all(re.fullmatch(r"\d{4}-\d\d-\d\d", x) for x in out)
    assert masked(spark, days[:20], "other")[0] != out[:20]


def test_pseudonyms_in_long_text(spark):
    text = "word " * 50000 + "4111111111111111 " + "word " * 50000
    assert len(masked(spark, [text])[0][0]) == len(text)


# ---- page text

PAGE = (
    '<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">'
    '<nav><ul><li><a href="/x">Menu</a></li></ul></nav><header>Site</header><div class="ad">Buy this fine thing now or never</div>'
    "%s<aside>Related things to read some other day</aside><footer>&copy; all rights are reserved here</footer></body></html>"
)
ARTICLE = (
    "<h1>A &amp; B</h1><p><b>First\n  para<br>goes on<p>Second&nbsp;one.</p><div class='cookie-notice'>We use cookies</div>"
    "<form>Sign <button>up</button></form><table><tr><td>cell 1<td>cell 2</table><!-- no --><div id=comments><p>I like it</p></div><p>x</p>"
)


def test_page_text(spark):
    pages = [PAGE % f"<article>{ARTICLE}</article>", PAGE % f"<div id=content>{ARTICLE}</div>", None, "", "<p>", "just text", "<a <b", "x" * 100000]
    rows = spark.createDataFrame([(i, "u", h, "clash") for i, h in enumerate(pages)] * 2, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.extract_text(rows).collect()}
    want = "A & B\n\nFirst para goes on\n\nSecond one.\n\ncell 1\n\ncell 2\n\nx"
    assert got[0] == want and got[1] == want
    assert [got[i] for i in (2, 3, 4)] == ["", "", ""] and got[5] == "just text" and got[7] == "x" * 100000


def test_page_text_goes_on_after_long_unwanted_elements(spark):
    first, last, other = "first word " * 15, "last word " * 50, "<aside>" + "buy this " * 100 + "</aside>"
    parts = {
        "paragraphs": f"<h1>Title</h1><p>{first}</p>{other}<p>{last}</p>",
        "sections": f"<section><h1>Title</h1>{first}</section>{other}<section>{last}</section>",
        "form": f"<h1>Title</h1><p>{first}</p><div class=ad><form>{'sign here ' * 300}</form></div><p>{last}</p>",
        "menu": f"<h1>Title</h1><p>{first}</p><nav>{'<a>see also</a> ' * 200}</nav><p>{last}</p>",
        "cells": f"<h1>Title</h1><p>{first}</p>{'<ul><li></ul>' * 300}<p>{last}</p>",
    }
    wholes = ["article", "main", "div", "section"]
    pages = {(k, w): PAGE % f"<{w}>{p}</{w}>" for k, p in parts.items() for w in wholes if k != "cells" or w in ("article", "main")}
    pages["sections", "body"] = PAGE % parts["sections"]
    rows = spark.createDataFrame([(i, "u", h) for i, h in enumerate(pages.values())], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(rows).collect()}
    want = ["Title", first.strip(), last.strip()]
    assert {k: got[i].split("\n\n") for i, k in enumerate(pages)} == dict.fromkeys(pages, want)


def test_page_tokens_take_linear_time():
    """Megabytes that never close a tag, a quote or an element; one pass each, where a rescan would take hours."""
    pages = ["<script " * 60_000, "<a " * 150_000, '<a "' * 100_001 + ">", "<a '\" <b \"" * 40_000, "<a" * 200_000]
    pages += ["<div>w" * 60_000 + "</p>" * 60_000, "<script>" * 50_000, "<!--" * 100_000, "<p>x" * 80_000]
    start = time.perf_counter()
    for source in pages:
        html_text.Page(source).text({})
    assert time.perf_counter() - start < 60


def test_page_tokens():
    def read(source):
        return list(html_text.tokens(source))

    assert read("a<b c='>'>d") == [("a", "", "", ""), (None, "", "b", " c='>'"), ("d", "", "", "")]
    assert read("<b x='<i>y") == [(None, "", "b", " x='"), (None, "", "i", ""), ("y", "", "", "")]
    assert read("1 < 2<!-- <p> -->3<!doctype x>4") == [(t, "", "", "") for t in ("1 ", "<", " 2", "3", "4")]
    assert read("<SCRIPT a>x<p></script >y<style>z") == [("y", "", "", "")]
    assert read("</p") == [(None, "/", "p", "")]


def test_page_text_of_nothing(spark):
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_digest_is_md5(spark):

    from loomgraph.llm.common import digest

    assert spark.range(1).select(digest(F.lit("é"))).first()[0] == hashlib.md5("é".encode()).digest()
