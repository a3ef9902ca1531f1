"""The training-data operators on small fixtures: contracts by brute force, and odd rows."""

import hashlib
import random
import struct
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordgauge.llm import bpe, chat_format, components, decontaminate, html_text, line_dedup, media, minhash, pii, quality, shingles, url_filter

ODD = [(1, "a\nb"), (2, ""), (3, None), (None, "x"), (4, "a\nb"), (4, "a\nb"), (5, " \t\n"), (6, "wide \U0001d4b3 é\n" * 3)]
DOCS = "doc_id long, text string"


def docs(spark, rows=ODD):
    return spark.createDataFrame(rows, DOCS)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_html_blocks_and_odd_pages(spark):
    model = html_text.train()
    page = "<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><ul><li><a href=/x>menu</a></li></ul></nav><div class=ad>buy now</div><article><h1>Head &amp; more</h1><p>One  two\nthree.<p>Four <b>five</b>.<br></article><section id=comments><div class=comment><p>nice post, I liked it</p></div></section><footer>&copy; me</footer></body></html>"
    got = html_text.main_texts([page, None, "", "only words here", "<p>unclosed <b>x", "<!-- never", "<div " * 50], model)
    assert got[0] == "Head & more\n\nOne two three.\n\nFour five."
    assert got[1] == got[2] == got[5] == "" and got[3] == "only words here"
    df = spark.createDataFrame([(1, "u", page, 7), (1, "u", page, 7), (None, None, None, None)], "page_id long, url string, html string, __extra int")
    out = html_text.extract(df, model=model)
    assert out.columns == ["page_id", "url", "__extra", "__text"] and out.count() == 3
    assert html_text.op1(df.limit(0)).count() == 0


def test_html_held_out_pages():
    model, r, right = html_text.train(), random.Random(123), 0
    for _ in range(60):
        source, mark = html_text.training_page(r)
        words = html_text.main_texts([source], model)[0].split()
        right += all(w.startswith(mark) or not w[0].isalpha() for w in words) and bool(words)
    assert right >= 54


def test_html_keeps_loose_text():
    model, r = html_text.train(), random.Random(31)
    say = lambda n, mark="": " ".join(mark + "".join(r.choice("aeilnrst") for _ in range(r.randint(2, 8))) for _ in range(n))
    for k in range(30):
        parts, ad = [say(40, "q"), say(25, "q")], f"<div class=ad>{say(60)}</div>"
        core = ["<br>".join(parts), f"<div class=content>{parts[0]}{ad}{parts[1]}</div>", f"<article>{parts[0]} <b>{parts[1]}</b></article>{ad}"][k % 3]
        page = f"<body><nav><ul><li><a href=/a>{say(2)}</a></li><li><a href=/b>{say(2)}</a></li></ul></nav>{core}<footer>&copy; {say(9)}</footer></body>"
        assert html_text.main_texts([page], model)[0].split() == " ".join(parts).split(), page


def test_html_decoding_never_contradicts():
    model, r = html_text.train(40), random.Random(5)
    for _ in range(30):
        page = html_text.Page(html_text.training_page(r)[0])
        states = page.decode(model.log_probabilities(page.features()))
        for i in range(1, len(states)):
            up = states[page.parent[i]]
            assert up == html_text.MIXED or states[i] == html_text.BOILER or up == states[i] == html_text.ARTICLE


HARD = ["a@b.c_x@d.e x@y a@b@c.d", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111 1111 1111 1111-1 +1 (23) 4567", "+123 456 78 9", "é@b.co ü4111111111111111ö", "", "   ", None, "\U0001d4b3 a.b@c.d-e.f. 10.0.0.1", "x@y.z " * 50, "1 " * 500, "no", "4785380592391139$$$ 4785380592391138 +1 (743) 555-3824,"]


def test_pii_base_spans_by_brute_force(spark):
    got = {r.doc_id: r for r in pii.op2(docs(spark, list(enumerate(HARD)))).collect()}
    for k, t in enumerate(HARD):
        want = ",".join(f"{a}:{b}:{c}" for a, b, c in pii.brute(t))
        assert got[k].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert (got[k].n_email, got[k].n_ip) == (want.count("email:"), want.count("ip:"))


def test_pii_long_texts_do_not_overflow(spark):
    long = ["1" * 200_000, "a" * 200_000 + "@b.c", "1 " * 60_000, "@" * 60_000, "x@y.z " * 5000]
    got = {r.doc_id: r for r in pii.op2(docs(spark, list(enumerate(long)))).collect()}
    assert got[1].spans.split(",")[0] == "email:0:200004" and got[4].n_email == 5000


def test_pii_discovers_by_context(spark):
    known = [(k, f"word reach me at user{k}@mail.example.com today") for k in range(8)]
    unseen = (99, "word reach me at hidden@localhost today")
    other = (100, "nothing here but 12 apples")
    got = {r.doc_id: r.spans for r in pii.op2(docs(spark, [*known, unseen, other])).collect()}
    assert got[99] == "email:17:33" and got[100] == "" and got[0].startswith("email:17:")


def planted(r):
    """Texts with (kind, start, end) of identifiers that no base pattern matches, and decoys of the same shapes in other contexts."""
    word = lambda: "".join(r.choice("aeinrst") for _ in range(r.randint(2, 8)))
    say = lambda n: " ".join(word() for _ in range(n))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card() -> str:
        front = "4" + digits(14)
        return next(c for c in (front + str(d) for d in range(10)) if pii.brute(c))

    octet = lambda: str(r.randint(1, 254))
    known = (lambda: f"{word()}.{digits(2)}@{word()}.com", lambda: ".".join(octet() for _ in range(4)), card, lambda: f"+1 ({digits(3)}) 555-{digits(4)}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(39)) + "a1"[:1])
    unseen = (lambda: f"{word()}{digits(2)}@intranet", lambda: "-".join(octet() for _ in range(4)), lambda: digits(4) + "." + digits(10), lambda: f"555-{digits(4)}", lambda: "sk_" + "".join(r.choice("0123456789ghjkmnpq") for _ in range(20)) + "7z")
    frames = (("write to {} any time", "mail: {}", "e-mail is {} if"), ("from host {} at", "address {} refused", "peer: {}"), ("charged to card {} on", "card no. {}", "visa {} expires"), ("call me on {} after", "tel: {}", "phone {} between"), ("token = {}", "api_key: {}", "secret {} leaked"))
    texts, want = [], {}
    for k in range(600):
        kind = k % 5
        frame = f"{say(r.randint(2, 6))}{r.choice([' ', '. ', chr(10)])}{r.choice(frames[kind])} {say(r.randint(2, 6))}"
        new = r.random() < 0.25
        value = (unseen if new else known)[kind]()
        texts.append(frame.format(value))
        if new:
            at = texts[-1].index(value)
            want[k] = (pii.KINDS[kind], at, at + len(value))
    for k in range(600, 900):  # the same shapes amid random words, and plain numbers
        value = r.choice([*unseen, lambda: digits(r.randint(1, 9))])()
        texts.append(f"{say(r.randint(2, 6))} {value} {say(r.randint(2, 6))}")
    return texts, want


def test_pii_discovery_in_varied_contexts(spark):
    texts, want = planted(random.Random(6))
    got = {}
    for row in pii.op2(docs(spark, list(enumerate(texts)))).collect():
        base = {f"{a}:{b}:{c}" for a, b, c in pii.brute(texts[row.doc_id])}
        got |= {(row.doc_id, x): 1 for x in row.spans.split(",") if x and x not in base}
        assert base <= set(row.spans.split(",")) and row.n_discovered == len([x for x in row.spans.split(",") if x]) - len(base)
    # hex digests after the learnt words are secrets too: seeds, not unseen
    found = {(k, x) for k, x in got if k in want or not x.startswith("secret")}
    right = {(k, "%s:%d:%d" % v) for k, v in want.items()}
    assert len(found & right) >= 0.8 * len(right) and len(found & right) >= 0.97 * len(found)
    assert sum(k >= 600 for k, _ in got) <= 3  # of 300


def test_pii_secrets_need_a_context(spark):
    digest = lambda k: hashlib.sha1(str(k).encode()).hexdigest()
    known = [(k, f"word{chr(97 + k)} token = \"{digest(k)}\" then") for k in range(8)]
    lone = [(50, f"commit {digest(50)} by me"), (51, 'here token = "sk_live_9zq8x7w6v5u4" now'), (52, "here token = 12 now")]
    got = {r.doc_id: r.spans for r in pii.op2(docs(spark, [*known, *lone])).collect()}
    assert all(got[k] == "secret:15:55" for k in range(8))
    assert (got[50], got[51], got[52]) == ("", "secret:14:34", "")


def test_pii_extra_columns_and_ties(spark):
    # a value that fits two kinds is listed once
    rows = [(k, f"ask at +1 (743) 555-38{k:02d} now") for k in range(12)] + [(40, "ask at 4111111111111112 now")]
    df = docs(spark, rows).withColumns({"kind": F.lit(1), "start": F.lit(2), "value": F.lit("x"), "row": F.lit(3)})
    got = {r.doc_id: r for r in pii.op2(df).collect()}
    assert got[40].spans == "phone:7:23" and got[0].n_phone == 1


def test_pii_odd_rows(spark):
    out = pii.op2(docs(spark))
    assert out.count() == len(ODD) and pii.op2(docs(spark).limit(0)).count() == 0


def test_quality(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("aeinrst") for _ in range(r.randint(2, 7)))
    good = [" ".join(word() for _ in range(80)) for _ in range(120)]
    bad = [" ".join(word().upper() + "!!" for _ in range(80)) for _ in range(120)]
    d = docs(spark, [*enumerate(good + bad), (900, None), (901, ""), (None, "x")])
    labels = spark.createDataFrame([(k, int(k < 120), 0) for k in range(240)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.op3(d, labels).collect()}
    held = [k for k in range(240) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out == (k in held) for k in range(240))
    assert sum(got[k].predicted == (k < 120) for k in held) >= 0.9 * len(held)
    assert got[900].score == got[901].score and 0 <= got[900].score <= 1 and got[None].held_out is False
    none = quality.op3(d, labels.limit(0)).collect()
    assert {x.score for x in none} == {0.5} and {x.predicted for x in none} == {1}
    assert quality.op3(d.limit(0), labels).count() == 0


def brute_lines(texts, least=10):
    key = lambda s: s.strip(" \t\n\x0b\f\r").translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))
    split = [(t or "").split("\n") for t in texts]
    count = {}
    for lines in split:
        for k in {key(s) for s in lines}:
            count[k] = count.get(k, 0) + 1
    return [(len(x), sum(key(s) != "" and count[key(s)] >= least for s in x), "\n".join(s for s in x if not (key(s) != "" and count[key(s)] >= least))) for x in split]


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_lines_by_brute_force(spark, broadcast):
    r = random.Random(3)
    texts = ["\n".join(r.choice(["Hot Line", " hot line\t", "É x", "é x", "", f"own {k} {r.random()}", "warm"]) for _ in range(r.randint(0, 6))) for k in range(80)] + [None, "", "\n\n", "hot line"]
    df = docs(spark, list(enumerate(texts))).withColumns({"n_chars": F.lit(1), "__pos": F.lit("clash")})
    got = {x.doc_id: (x["__n_lines"], x["__n_dropped"], x.text) for x in line_dedup.line_dedup(df, broadcast_keys=broadcast).collect()}
    assert [got[k] for k in range(len(texts))] == brute_lines(texts)
    assert line_dedup.op4(docs(spark)).count() == len(ODD) and line_dedup.op4(docs(spark).limit(0)).count() == 0


def test_media_round_trip(spark):
    out = rows(media.op5(docs(spark)), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes")
    want = []
    for k, t in ODD:
        n, p = media.padded(t)
        want.append((k, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(media.to_wav(p))))
    assert out == sorted(want, key=str) and all(w[2] % 192 == 0 and w[2] for w in want)
    assert media.op5(docs(spark).limit(0)).count() == 0


def test_media_ranges_and_retries(spark, tmp_path):
    d = docs(spark, [(k, "x" * k * 50) for k in range(60)])
    media.write_archives(d, "doc_id", "text", str(tmp_path), archive_bytes=20_000)
    whole = media.read_archives(spark, str(tmp_path))
    tiny = media.read_archives(spark, str(tmp_path), range_bytes="100", batch_bytes="500")
    assert rows(whole, "archive", "offset", "payload") == rows(tiny, "archive", "offset", "payload") and whole.count() == 60
    victim = sorted(tmp_path.glob("*.zip"))[0]
    raw = bytearray(victim.read_bytes())
    raw[60] ^= 0xFF
    victim.write_bytes(raw)
    kept = media.read_archives(spark, str(tmp_path), permissive="true")
    assert kept.count() == 60 and kept.filter("error is not null").count() == 1
    with pytest.raises(Exception, match="member at"):
        media.read_archives(spark, str(tmp_path)).collect()


def test_media_digests_made_by_the_reader(spark, tmp_path):
    """Media bytes stay in the reader's worker: one Python step reads a member and describes it."""
    plan = media.op5(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "payload_sha256" in plan and "MapInArrow" not in plan and "payload#" not in plan
    media.write_archives(docs(spark, [(k, "é" * k * 50) for k in range(60)]), "doc_id", "text", str(tmp_path), archive_bytes=2_000)
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for made, shown in [({}, {}), ({"permissive": "true"}, {"range_bytes": "100", "batch_bytes": "500", "permissive": "true"})]:
        want = [(r.offset, *([None] * 8 if r.payload is None else media.describe(r.member, bytes(r.payload))), r.error) for r in media.read_archives(spark, str(tmp_path), **made).collect()]
        got = rows(media.read_archives(spark, str(tmp_path), digests="true", **shown), "offset", "key", *names, "error")
        assert got == sorted(want, key=str) and len(got) == 60 and sum(r[-1] is not None for r in got) == bool(made)
        victim = sorted(tmp_path.glob("*.zip"))[0]
        raw = bytearray(victim.read_bytes())
        raw[60] ^= 0xFF
        victim.write_bytes(raw)


def test_media_written_in_bounded_batches(spark, tmp_path, monkeypatch):
    """A worker of the writer gets some 4 MB of texts at once, not 10,000 rows or 64 MB; the session's bound stays."""
    plain, seen = media.padded, str(tmp_path / "seen")

    def padded(text):
        import sys

        import pyarrow as pa

        with open(seen, "a") as f:  # the bytes of the caller's batch
            f.writelines(f"{x.nbytes}\n" for x in sys._getframe(1).f_locals.values() if isinstance(x, pa.RecordBatch))
        return plain(text)

    monkeypatch.setattr(media, "padded", padded)
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(bound)
    df = spark.range(40).selectExpr("id doc_id", "repeat('x', 1000000) text").coalesce(1)
    media.write_archives(df, "doc_id", "text", str(tmp_path / "media"))
    held = [int(x) for x in open(seen)]
    assert len(held) == 40 and max(held) < 2 * media.BATCH_BYTES and spark.conf.get(bound) == before
    assert media.read_archives(spark, str(tmp_path / "media")).filter("length(payload) > 1000000").count() == 40


def brute_near(texts):
    sets, comp = {}, {}
    for k, t in texts:
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
        comp[k] = k
    ids = [k for k, _ in texts]
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if a < b and comp[a] != comp[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return [(k, len(sets[k]), comp[k]) for k in ids]


def near_texts():
    r, out = random.Random(7), []
    vocab = [f"w{i}" for i in range(400)]
    for g in range(6):
        base = [r.choice(vocab) for _ in range(r.choice([30, 80, 200]))]
        for _ in range(r.choice([1, 4, 12])):
            w = list(base)
            for _ in range(r.randint(0, len(w) // 20)):
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append(" ".join(w))
    return list(enumerate([*out, "one two", "ONE two", "", None, "\t", "a b c d e", "A B C D E"]))


def test_near_duplicates_by_brute_force(spark):
    t = near_texts()
    got = {x.doc_id: x for x in minhash.op6(docs(spark, t)).collect()}
    want = brute_near(t)
    assert [(k, got[k].n_shingles, got[k].component_id) for k, _ in t] == want
    assert all(got[k].kept == (k == c) for k, _, c in want)


def test_near_duplicates_chain_beyond_the_head(spark):
    # each text is near its neighbour only: links outside the star must be found
    w, chain = [f"c{i}" for i in range(120)], []
    for k in range(8):
        chain.append((k, " ".join(w[k * 8 : k * 8 + 80])))
    got = minhash.op6(docs(spark, chain)).collect()
    assert {x.doc_id: x.component_id for x in got} == {k: c for k, _, c in brute_near(chain)}


def test_near_duplicates_odd_rows(spark):
    out = minhash.op6(docs(spark))
    assert out.count() == len(ODD) and minhash.op6(docs(spark).limit(0)).count() == 0
    assert all(x.kept and x.component_id is None for x in out.filter("doc_id is null").collect())


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (3, 9), (20, 21), (5, 5)] + [(k, k + 1) for k in range(100, 140)]
    got = dict(tuple(r) for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[k] for k in (1, 2, 3, 8, 9)} == {1} and got[21] == 20 and {got[k] for k in range(100, 141)} == {100}


def test_shingles():
    assert shingles.overlap(shingles.shingle_set("a b c d e f"), shingles.shingle_set("A b C d e")) == (1, 2)
    assert len(shingles.shingle_set("a b")) == 1 and len(shingles.shingle_set(" ")) == 0 and len(shingles.shingle_set("x " * 50)) == 1


TEXTS = ["", None, "Hello  world's 12 test\n\n  end", "   ", "é" * 50, "\U0001f600 ok", "a" * 700, " " * 700, "it's  they're\t\n x1y2 ", "日本語 テスト。" * 40]


@pytest.mark.parametrize(("chunk", "overlap"), [(32_768, 512), (40, 12), (7, 3)])
def test_bpe_equals_the_library(spark, chunk, overlap):
    path, pattern = bpe.tokenizer()
    r = random.Random(chunk)
    texts = TEXTS + ["".join(r.choice("ab 1.\n' sté") for _ in range(300)) for _ in range(10)]
    df = docs(spark, list(enumerate(texts))).withColumn("__rest", F.lit("clash"))
    got = {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in bpe.digests(bpe.encode(df, path, pattern, chunk=chunk, overlap=overlap)).collect()}
    assert [got[k] for k in range(len(texts))] == [bpe.brute(t, path, pattern) for t in texts]


def test_bpe_odd_rows(spark):
    assert bpe.op7(docs(spark)).count() == len(ODD) and bpe.op7(docs(spark).limit(0)).count() == 0
    path, pattern = bpe.tokenizer()
    ids = bpe.encode(docs(spark, [(1, "round trip ü")]), path, pattern).first()["__ids"]
    assert bpe.decode(ids, path, pattern).decode() == "round trip ü" and struct.unpack("<I", ids[:4])[0] < 50256


def test_pii_pattern_of_grouped_cards(spark):
    texts = []
    for k in range(12):
        front = f"{4100 + k}" + "12345678123"
        card = next(c for c in (front + str(d) for d in range(10)) if pii.brute(c) and pii.brute(c)[0][0] == "card")
        texts.append(f"my card number {card[:4]} {card[4:8]} {card[8:12]} {card[12:]} then{chr(97 + k)}")
    texts.append("my card number 4111111111111112 otherwise")
    got = {r.doc_id: r.spans for r in pii.op2(docs(spark, list(enumerate(texts)))).collect()}
    assert got[12] == "card:15:31" and all(got[k] == "card:15:34" for k in range(12))


def bench_items():
    r = random.Random(11)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(500)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(n))) for k, n in enumerate([12, 12, 25, 40, 60, 3])]
    return r, vocab, items


def test_decontamination(spark):
    r, vocab, items = bench_items()
    noise = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    texts, want = [], []
    for k, (item, t) in enumerate(items):
        w = t.split()
        for m in range(len(w) // 10):
            w[(m * 7) % len(w)] = "zzz"
        texts += [f"{noise(60)} {t.upper()}! {noise(30)}", f"{noise(60)} {' '.join(w)} {noise(5)}", noise(120)]
        want += [(3 * k, item), (3 * k + 1, item)]
    texts += ["For " * 400, "", None, items[3][1]]
    want.append((len(texts) - 1, 3))
    b = spark.createDataFrame([*items, (50, None), (51, "")], "item_id long, text string")
    d = docs(spark, list(enumerate(texts))).withColumn("item_id", F.lit(0))
    assert rows(decontaminate.op8(d, b), "doc_id", "item_id") == sorted(want, key=str)
    kept = {x.doc_id for x in decontaminate.decontaminate(d, b).collect()}
    assert kept == set(range(len(texts))) - {k for k, _ in want}
    assert decontaminate.op8(d, b.limit(0)).count() == 0 and decontaminate.op8(d.limit(0), b).count() == 0


def test_edit_distance_by_brute_force():
    def plain(a, b, k):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return min(min(row[max(0, len(a) - k) :], default=len(a)), k + 1)

    r = random.Random(2)
    for _ in range(500):
        a = [r.randint(0, 3) for _ in range(r.randint(1, 12))]
        b, k = [r.randint(0, 3) for _ in range(r.randint(0, 14))], r.randint(0, 4)
        assert decontaminate.edit_distance(a, b, k) == plain(a, b, k), (a, b, k)


@pytest.mark.parametrize("n", [5, 8, 9, 10, 15, 20, 25, 40, 60, 80, 100, 200])
def test_decontamination_recall_at_the_limit(n):
    """Recall against the exhaustive edit distance, which finds all of these: exactly the permitted edits, one kind at a time."""
    r = random.Random(n)
    vocab = [f"w{k}" for k in range(400)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(say(n))) for k in range(40)]
    index, allowed = decontaminate.Index(items), decontaminate.limit(n)
    assert allowed == n // 5
    for kind in ("substitute", "delete", "insert", "mixed"):
        found = 0
        for k, t in items:
            text = say(40) + [str(x) for x in decontaminate.edited(t.split(), kind, allowed, r)] + say(40)
            got = {m[0]: m for m in index.matches(" ".join(text))}
            if k in got:
                _, start, _, d = got[k]
                assert d <= allowed and d == decontaminate.edit_distance(t.split(), text[start : start + n + allowed], allowed)
                found += bool(index.matches(" ".join(text), True))
        assert found >= 0.95 * len(items), (n, kind, found)


def test_decontamination_of_long_texts():
    r = random.Random(4)
    items = [(0, " ".join(f"w{r.randrange(300)}" for _ in range(50))), (1, "aa bb " * 10)]
    index = decontaminate.Index(items)
    noise = [f"x{r.randrange(5000)}" for _ in range(200_000)]
    assert index.matches(" ".join(noise)) == []
    noise[150_000:150_000] = items[0][1].split()
    assert index.matches(" ".join(noise)) == [(0, 150_000, 50, 0)]
    # an item of few distinct pairs, in a text shorter than it
    assert index.matches("aa bb " * 9) == [(1, 0, 20, 2)]


def test_decontamination_by_brute_force():
    r = random.Random(9)
    for _ in range(400):
        few = "abcdefghijklmnop"[: r.choice([1, 2, 3, 16])]
        items = [(k, " ".join(r.choice(few) for _ in range(r.randint(1, 16)))) for k in range(4)]
        t = [r.choice(few + "z") for _ in range(r.randint(0, 25))]
        if r.random() < 0.7:
            t[5:5] = [c for c in items[0][1].split() if r.random() < 0.9]
        want = []
        for k, item in items:
            a = [hash(c) for c in item.split()]
            allowed = decontaminate.limit(len(a))
            tried = [(decontaminate.edit_distance(a, [hash(c) for c in t[p : p + len(a) + allowed]], allowed), p) for p in range(len(t))]
            near = min(tried, default=(allowed + 1, 0))
            if near[0] <= allowed:
                want.append((k, near[1], len(a), near[0]))
        index = decontaminate.Index(items)
        assert index.matches(" ".join(t)) == want, (items, t)
        assert bool(index.matches(" ".join(t), True)) == bool(want)


def test_blocks_of_items(spark, monkeypatch):
    _, _, items = bench_items()
    b = spark.createDataFrame(items, "item_id long, text string")
    assert [len(x) for x in decontaminate.blocks(b, 4)] == [4, 2]


TURNS = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\nx"), (1, 2, "assistant", "a &amp; b &lt;| <"), (2, 0, None, None), (2, 0, "user", "tie"), (2, 0, "user", "tie"), (None, 5, "system", "null id"), (3, 0, "as\nsistant", "<|im_end|"), (3, 1, "assistant", "")]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    done = {r.conv_id: r for r in chat_format.format_conversations(df).collect()}
    for c in {t[0] for t in TURNS}:
        want = sorted((t[1], t[2] or "", t[3] or "") for t in TURNS if t[0] == c)
        assert [(x.role, x.text) for x in done[c].turns] == [w[1:] for w in want]
        assert done[c].formatted.count("<|im_start|>") == done[c].formatted.count("<|im_end|>") == len(want)
    assert "hi<|im_end|>" in done[1].formatted and chat_format.op9(df.limit(0)).count() == 1
    out = {r.conv_id: r for r in chat_format.op9(df).collect()}
    said = "<|im_end|><|im_start|>assistant ok"
    assert out[-1].n_turns == 2 and out[-1].loss_chars == len(said) and out[-1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_chat_parser_rejects(spark):
    bad = ["x", "<|im_start|>user\nhi", "<|im_start|>user hi<|im_end|>\n", "<|im_start|>u\na<|im_end|>b<|im_end|>\n"]
    df = spark.createDataFrame([(b,) for b in bad], "t string")
    assert all(r[0] is None for r in df.select(chat_format.parse(F.col("t"))).collect())


URLS = ["http://a.net/x", "https://www.Example.NET/en/1?q=/de/", "http://example.net/de/1", "http://m.example.com/de/", "http://x.org/fr/", "http://notnet/fr/", None, "no scheme", "http://", "http://a.net", "http://a.net?x", "ftp://b.example.com/en/1#top", "http://free-bets.example.com/en/2"]


def test_urls(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("html", F.lit("x"))
    got = {r.page_id: r for r in url_filter.op10(df).collect()}
    assert [got[k].rule for k in range(13)] == ["net/", "example.net/en/", "net/", "example.com/de/", "org/fr/", None, None, None, None, None, None, None, None]
    assert (got[1].host, got[1].path) == ("www.example.net", "/en/1") and (got[6].host, got[7].path, got[8].host) == ("", "", "")
    assert got[11].path == "/en/1" and got[9].host == "a.net" and got[9].path == ""
    assert [got[k].verdict for k in (0, 1, 3, 4, 6, 12)] == ["block", "allow", "block", "allow", "allow", "block"]
    assert url_filter.op10(df.limit(0)).count() == 0


@pytest.mark.skipif(not Path("/root/testdata").exists(), reason="no driver tables here")
def test_url_table_is_apart_from_the_data(spark):
    urls = [r.url for sf in ("sf0.001", "sf0.01", "sf0.1") for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("url").collect()]
    hosts = {u.split("/")[2].lower() for u in urls if u and "://" in u}
    stems = set(url_filter.BAD + url_filter.GOOD)
    assert hosts and not [h for h in hosts if any(h.startswith(f"{x}.") or f".{x}." in h for x in stems)]


def test_url_model_on_held_out_stems():
    table = url_filter.training_table()
    held = ("spam-farm", "casino-win", "cheap-pills", "garden", "astronomy", "city.council")
    w, b = url_filter.train([r for r in table if not any(h in r[0] for h in held)])
    right = []
    for host, path, label in [r for r in table if any(h in r[0] for h in held)]:
        ids = url_filter.gram_ids(host, path)
        right.append((b + w[ids].sum() / len(ids) ** 0.5 > 0) == bool(label))
    assert sum(right) >= 0.7 * len(right), right


def test_chat_mask_cuts_the_formatted_text(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit(1), "mask": F.lit(2), "src": F.lit(3)})
    for r in chat_format.format_conversations(df).collect():
        cuts = [r.formatted[m.start : m.end] for m in r.mask]
        plain = [x.replace("&lt;|", "<|").replace("&amp;", "&") for x in cuts]
        wanted = [t[3] or "" for t in sorted(t for t in TURNS if t[0] == r.conv_id and t[2] == "assistant")]
        assert plain == wanted and r.loss == "".join(wanted)
        # nothing but bodies of assistant turns lies under the mask
        assert all(r.formatted[: m.start].endswith("<|im_start|>assistant\n") and r.formatted[m.end :].startswith("<|im_end|>\n") for m in r.mask)


def test_chat_long_conversation(spark):
    turns = [(1, k, "assistant" if k % 2 else "user", f"<|im_end|>{k}" if k % 7 == 0 else "x" * 200) for k in range(6000)] + [(2, 0, "assistant", "é<|" * 500_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat_format.op9(df).collect()}
    said = "".join(t[3] for t in turns if t[0] == 1 and t[2] == "assistant")
    assert out[1].n_turns == 6000 and out[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert out[2].loss_chars == 1_500_000 and out[2].formatted_chars > 1_500_000


def brute_url(url):
    """Host, path, rule and its verdict by plain string work."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def test_urls_by_brute_force(spark):
    r = random.Random(12)
    hosts = ["a.net", "example.net", "www.Example.com", "x.org", "org", "notorg", "sub.example.net", "ÄB.example.com", "news.library.example.org", "hot-deals.example.com", "a:80", ""]
    tails = ["", "/", "/en/", "/en/1", "/de/", "/fr/x?y=://z/", "?q=/en/", "#/de/", "//en/", "/EN/"]
    urls = [r.choice(["http://", "https://", "ftp://", "", "://", "a://b://"]) + r.choice(hosts) + r.choice(tails) for _ in range(400)] + ["http://a.example.com/" + "x" * 100_000, "", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"__host": F.lit("clash"), "__score": F.lit("clash"), "host": F.lit(1)})
    weights, bias = url_filter.train(url_filter.training_table())
    for row in url_filter.op10(df).collect():
        host, path, rule, verdict = brute_url(urls[row.page_id])
        assert (row.host, row.path, row.rule) == (host, path, rule), urls[row.page_id]
        ids = url_filter.gram_ids(host, path)
        score = 1 / (1 + np.exp(-(bias + (weights[ids].sum() / len(ids) ** 0.5 if ids else 0))))
        assert abs(row.score - score) < 1e-5 and row.verdict == (verdict or ("block" if score >= 0.5 else "allow"))
    judged = url_filter.judge_urls(df)
    assert judged.columns == ["page_id", "url", "host", "__host", "__path", "__rule", "__score", "__verdict"]


def test_bpe_very_long_texts(spark):
    path, pattern = bpe.tokenizer()
    r = random.Random(5)
    base = "".join(r.choice(["the ", "of\n", "12 ", "räksmörgås ", "it's ", "foo_bar;  ", "日本 "]) for _ in range(50_000))
    texts = [base * 20, base + "7" * 500_000 + base, "a" * 1_000_000, " " * 300_000 + "x", base + "ab" * 40_000 + " " + base]
    df = docs(spark, list(enumerate(texts))).withColumns({"__ids": F.lit(1), "__n_tokens": F.lit(2), "__decoded": F.lit(3), "row": F.lit(4), "k": F.lit(5)})
    encoded = bpe.encode(df, path, pattern)
    assert encoded.columns == ["doc_id", "row", "k", "__n_tokens", "__ids", "__decoded"]
    got = {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in bpe.digests(encoded).collect()}
    assert [got[k] for k in range(len(texts))] == [bpe.brute(t, path, pattern) for t in texts]


@pytest.mark.parametrize("unit", ["the räk 12 ", "a", "7"])
def test_bpe_stitch_is_linear(unit):
    path, pattern = bpe.tokenizer()
    codec = bpe.Codec(Path(path).read_bytes(), pattern)

    def took(size):
        text = unit * (size // len(unit))
        chunks = [(at, text[at : at + 4096 + 128], bpe.boundaries(codec, text[at : at + 4096 + 128], at + 4096 + 128 >= len(text))) for at in range(0, len(text), 4096)]
        best = 9.0
        for _ in range(2):
            began = time.perf_counter()
            pieces = bpe.stitch(codec, chunks)
            best = min(best, time.perf_counter() - began)
        assert "".join(pieces) == text
        return best

    assert took(4_000_000) < 8 * took(1_000_000) + 0.05


def test_quality_by_brute_force(spark):
    import zstandard

    r = random.Random(3)
    word = lambda: "".join(r.choice("aeinrst") for _ in range(r.randint(2, 7)))
    texts = [" ".join(word() if k < 60 else word().upper() + "##" for _ in range(r.randint(1, 120))) for k in range(120)] + ["", None, "x" * 300_000]
    d = docs(spark, [*enumerate(texts), (0, texts[0])]).withColumns({"__score": F.lit("clash"), "quality": F.lit("clash")})
    labels = spark.createDataFrame([(k, int(k < 60), 0) for k in range(120)] + [(5, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(d, labels)
    packers = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(x), write_content_size=False, write_checksum=False, write_dict_id=False) for x in model["dictionaries"]]
    rows = quality.op3(d, labels).collect()
    assert len(rows) == len(texts) + 1 and quality.score(d, model).columns == ["doc_id", "text", "quality", "__score"]
    for row in rows:
        data = (texts[row.doc_id] or "").encode()
        good, bad = (len(p.compress(data)) for p in packers)
        f = ((good - bad) / len(data), (good - bad) / (good + bad), min(good, bad) / len(data)) if data else (0.0, 0.0, 0.0)
        z = model["w"][3] + sum(w * (v - m) / s for w, v, m, s in zip(model["w"], f, model["mean"], model["sd"], strict=False))
        assert abs(row.score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9
        assert row.predicted == int(row.score >= 0.3) and row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)


def test_quality_fit_is_bounded(spark, monkeypatch):
    d = docs(spark, [(k, f"{'good' if k % 2 else 'BAD!'} text {k} " * (50 if k > 3 else 5000)) for k in range(80)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(80)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality, "FIT_BYTES", 4000)
    monkeypatch.setattr(quality, "FIT_TEXT", 2000)
    model = quality.fit(d, labels, 30)
    assert sum(map(len, model["dictionaries"])) < 20_000


def test_lines_with_clashing_columns(spark):
    rows = [(k, f"hot\nown{k}") for k in range(12)] + [(99, "hot\n" * 200_000 + "end")]
    df = docs(spark, rows).withColumns({"__n_lines": F.lit("x"), "__n_dropped": F.lit("x"), "__": F.lit("a"), "__row": F.lit("b"), "__rest": F.lit("c"), "c0": F.lit("d"), "__h1": F.lit("e")})
    out = line_dedup.line_dedup(df)
    assert out.columns == ["doc_id", "text", "__", "__row", "__rest", "c0", "__h1", "__n_lines", "__n_dropped"]
    got = {r.doc_id: r for r in out.collect()}
    assert (got[3].text, got[3]["__"], got[3]["__rest"], got[3]["c0"]) == ("own3", "a", "c", "d")
    assert (got[99].text, got[99]["__n_lines"], got[99]["__n_dropped"]) == ("end", 200_001, 200_000)


def test_media_of_text_ids_and_clashing_columns(spark):
    rows = [("a-b/c", "one"), ("!", "two"), (None, "three"), ("", "x" * 3_000_000), ("ü 1", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumns({"member": F.lit(1), "payload": F.lit(2), "key": F.lit(3)})
    got = {r.doc_id: (r.n_bytes, r.payload_bytes) for r in media.op5(df).collect()}
    assert got == {k: (len((t or "").encode()), len(media.padded(t)[1])) for k, t in rows}


def test_near_duplicates_in_a_hot_key(spark):
    """Hundreds of texts that share much less than the threshold, and near copies among them: keys are hot, links are few."""
    r = random.Random(13)
    shared = [f"s{k}" for k in range(120)]
    texts = []
    for g in range(150):
        own = shared + [f"o{g}x{k}" for k in range(60)]
        texts.append(" ".join(own))
        if g % 10 == 0:
            own[-1] = "changed"
            texts.append(" ".join(own))
    texts += [" ".join(shared + [f"z{k}" for k in range(5 * m)]) for m in range(8)]  # a chain of growing texts
    r.shuffle(texts)
    t = list(enumerate(texts))
    d = docs(spark, [*t, (3, texts[0]), (len(t), "w " * 100_000)]).withColumns({"rep": F.lit(1), "key": F.lit(2), "set_id": F.lit(3)})
    got = {(x.doc_id, x.n_shingles): x.component_id for x in minhash.op6(d).collect()}
    for k, n, c in brute_near(t):
        assert got[(k, n)] == c or k == 3
    assert got[(len(t), 1)] == len(t)


def test_near_duplicates_of_a_key_in_cells(spark, monkeypatch):
    """A key of more pairs than a task compares is dealt over cells: each pair meets in one of them."""
    rest = spark.createDataFrame([(k, r, 10, r, 0) for k, m in ((1, 40), (2, 3)) for r in range(m)], "key long, rep long, n int, comp long, home long")
    monkeypatch.setattr(minhash, "PAIRS_A_TASK", 100)
    x, y = minhash.sides(rest, rest, ["rep"])
    met = x.join(y, ["key", "i", "j"]).groupBy("key", "i", "j").count().collect()
    assert x.join(y, ["key", "i", "j"]).select("key", "x_rep", "y_rep").distinct().count() == sum(m["count"] for m in met) == 39 * 40 + 2 * 3
    assert len([m for m in met if m.key == 1]) == 16 and len([m for m in met if m.key == 2]) == 1
    monkeypatch.setattr(minhash, "PAIRS_A_TASK", 50)
    test_near_duplicates_in_a_hot_key(spark)


def test_near_duplicates_around_a_common_line(spark):
    """Thousands of short texts around one line, below the threshold: over 100 million pairs of equal keys."""
    line = " ".join(f"s{k}" for k in range(24))
    t = [(g, f"{line} " + " ".join(f"o{g}x{k}" for k in range(8))) for g in range(5000)]
    t += [(5000 + g, t[g][1] + " end") for g in range(0, 5000, 100)]
    began = time.time()
    got = {r.doc_id: r.component_id for r in minhash.op6(docs(spark, t)).collect()}
    assert got == {k: k % 5000 for k, _ in t}
    assert time.time() - began < 60


def test_decontamination_with_clashing_columns(spark):
    b = spark.createDataFrame([(7, "one two three four five six")], "item_id long, text string")
    d = docs(spark, [(1, "say one two three four five six"), (2, "nothing"), (2, "nothing")]).withColumns({"item_id": F.lit("x"), "start": F.lit(1), "distance": F.lit(2)})
    kept = decontaminate.decontaminate(d, b)
    assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [2, 2]
    assert [tuple(r) for r in decontaminate.op8(d, b).collect()] == [(1, 7, 1, 6, 0)]
