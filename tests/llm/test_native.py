"""Privacy, quality, search and archives against plain Python and SQL."""

from __future__ import annotations

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest

from survloom.llm import privacy, quality, topk, warc

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def plain_spans(text):
    def valid(kind, match):
        digits = re.sub("[^0-9]", "", match)
        if kind == "ip":
            return all(int(p) <= 255 for p in match.split("."))
        return {"email": True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]

    found = [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for n, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if valid(kind, m[0])]
    return [x[2] for x in sorted(found)]


PRIVATE = [
    "", None, "mail a.b@c-d.ef and x@y.z%w@v.u now", "a@b a@b. @c.d a@.b a@b..c", "1.2.3.4.5.6.7.8 256.1.1.1 0300.1.1.1 0001.2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111  1111", "+1 (456) 555-2186 +12 +1((((9 +49 30 1234567 ++4930123456789", "🙂é +49 30 1234567 é@é a@b.co",
    "x" * 60_000, "1" * 60_000, "a@" + "b." * 20_000 + "c", "1.1.1.1 " * 400,
]


def test_base_spans(spark):
    df = spark.createDataFrame([(i, t, "e", 1) for i, t in enumerate(PRIVATE)], "doc_id long, text string, base string, key int")
    rows = {r.doc_id: r for r in privacy.analysed(df).select("doc_id", privacy.listed(privacy.F.col("base")).alias("b")).collect()}
    for i, text in enumerate(PRIVATE):
        assert rows[i].b == ",".join(plain_spans(text or "")), i
    assert privacy.analysed(df.limit(0)).count() == 0


def plain_disclosure(texts: list[str]) -> dict:
    """Shares (entity, term) of the module's formula, counted over different texts."""
    held, terms = {}, {}
    for text in set(texts):
        found, rest = set(), text
        for span in reversed(plain_spans(text)):
            kind, start, end = span.split(":")
            value = text[int(start) : int(end)].lower()
            digits = re.sub("[^0-9]", "", value)
            part = {"email": value.split("@")[-1], "ip": ".".join(value.split(".")[:2]), "card": digits[:6], "phone": digits[:4]}[kind]
            found |= {kind, f"{kind}/{part}", f"{kind}:{digits if kind in ('card', 'phone') else value}"}
            rest = rest[: int(start)] + " " + rest[int(end) :]
        held[text] = found
        terms[text] = (set(re.findall(r"[^\W_]{4,}", rest.lower())), set(re.findall(r"[^\W_]{4,}", text.lower())))
    shares, n = {}, len(held)
    for entity in set().union(*held.values()):
        having = [t for t in held if entity in held[t]]
        information = -math.log2(len(having) / n)
        for term in set().union(*(terms[t][0] for t in having)):
            both = sum(term in terms[t][0] for t in having) - 1
            of = max(both, sum(term in terms[t][1] for t in held) - 1)
            if both > 0 and information > 0:
                z = privacy.QUANTILE
                low = (both + z * z / 2 - z * math.sqrt(both * (of - both) / of + z * z / 4)) / (of + z * z)
                shares[entity, term] = 1 + math.log2(low) / information
    return {"held": held, "terms": terms, "shares": shares}


def plain_terms(text: str, counted: dict) -> list[str]:
    """Term spans of one text: kind:start:end."""
    base = [tuple(map(int, s.split(":")[1:])) for s in plain_spans(text)]
    out = []
    for m in re.finditer(r"[^\W_]{4,}", text):
        term = m[0].lower()
        if term not in counted["terms"][text][0] or any(s < m.end() and e > m.start() for s, e in base):
            continue
        share = max((counted["shares"].get((e, term), 0) for e in counted["held"][text]), default=0)
        if share >= privacy.GENERALISE:
            out.append(f"{'removed' if share >= privacy.REMOVE else 'generalised'}:{m.start()}:{m.end()}")
    return out


def disclosing_rows() -> list[tuple]:
    draw = random.Random(11)
    words = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(300):
        text = " ".join(draw.choices(words, k=12))
        if i % 20 == 0:
            text += f" write to Zacharias or ZACHARIAS the boss, mail boss{i % 3}@firm.example soon"
        if i % 15 == 0:
            text += f" dial secretary +1 (743) 555-{1000 + i} then"
        if i % 50 == 0:
            text += " host alpha 10.0.0.1 zacharias"
        rows.append((i, text))
    return [*rows, (500, "no one here knows zacharias"), (501, None), (502, ""), (None, rows[0][1]), (0, rows[0][1]), (0, rows[0][1])]


def test_terms_that_disclose_equal_plain_counts(spark):
    rows = disclosing_rows()
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], "doc_id long, text string, spans int, key string")
    counted = plain_disclosure([t or "" for _, t in rows])
    out = privacy.analysed(df).select("doc_id", privacy.listed(privacy.F.filter("spans", lambda s: s["kind"].isin("generalised", "removed"))).alias("t")).collect()
    got = sorted(((r.doc_id, r.t) for r in out), key=repr)
    want = sorted(((d, ",".join(plain_terms(t or "", counted))) for d, t in rows), key=repr)
    assert got == want
    assert any("generalised" in t or "removed" in t for _, t in want)


def test_copies_count_once(spark):
    """Thirds and sevenths of a text add up to whole texts, however many there are."""
    rows = [(f"common word{i}", n) for i in range(3000) for n in (None, 3, 7)[i % 3 : i % 3 + 1]]
    long = spark.createDataFrame([r for r in rows for _ in range(r[1] or 1)], "text string, copies long")
    counts = {r.term: r.n_term for r in privacy.term_counts(long).collect()}
    assert counts["common"] == 3000 and counts["word1"] == counts["word2"] == counts["word3"] == 1


def test_terms_are_replaced_wherever_they_stand(spark):
    rows = disclosing_rows()
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], "doc_id long, text string, spans int, key string")
    clean = privacy.sanitise(df)
    assert clean.columns == df.columns and clean.count() == len(rows)
    text = {r.doc_id: r.text for r in clean.collect()}
    assert not re.search("zacharias|boss|secretary", text[20] + text[60], re.I) and "<EMAIL>" in text[20] and "<PHONE>" in text[60]
    # A text without personal data stays as it is, whatever its terms.
    assert text[500] == rows[300][1] and text[501] is None and text[502] == "" and text[1] == rows[1][1]
    assert privacy.sanitise(df.limit(0)).count() == 0


LONG = "one two three four five six seven eight nine ten"
QUALITY = [None, "", " \n \n", LONG, f"{LONG} {LONG} {LONG}", "a # b $$ <c>\n\nx\nx\n x\nthe", "w " * 30_000, "ünï cödé\x0bx the the", f"{LONG}\n{LONG} the of and to in that is was for on"]


def duck(sql, name, schema, rows):
    connection = duckdb.connect()
    connection.execute(f"CREATE TABLE {name} ({schema})")
    if rows:
        connection.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    out = connection.execute(sql)
    return [d[0] for d in out.description], sorted(out.fetchall(), key=str)


def test_quality_measures(spark):
    rows = [(i, t) for i, t in enumerate(QUALITY)] + [(3, LONG)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int")
    names, want = duck(quality.OP9_SQL, "documents", "doc_id BIGINT, text VARCHAR", rows)
    assert sorted((tuple(r) for r in quality.judged(df).select(*names).collect()), key=str) == want
    assert quality.judged(df.limit(0)).count() == 0
    plan = quality.judged(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_SHARD", 20)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    draw = random.Random(4)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(6)]) for i in range(150)] + [(200 + i, [0.5] * 6) for i in range(40)]
    # Repeated ids, also of queries, are rows of their own.
    rows += [(7, [0.9] * 6), (7, [0.8] * 6), (40, [0.7, 0.1] * 3), (40, rows[40][1]), (220, [0.5] * 6)]
    rows += [(300, [0.1, 0.2]), (320, [0.3, 0.1]), (340, [1.0, None] * 3), (360, [float("nan")] * 6), (380, None), (400, [])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows] + [(None, [0.1] * 6, 1, 2)], "vec_id long, embedding array<float>, v int, row int")
    names, want = duck(topk.OP7_SQL, "embeddings", "vec_id BIGINT, embedding FLOAT[]", rows)
    found = topk.search(topk.quantised(df, "vec_id", "embedding"), topk.F.col("id") % 20 == 0).select(*names)
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == want
    assert sum(r[names.index("query_id")] == 40 for r in got) == 3 * 20
    assert topk.search(topk.quantised(df.limit(0), "vec_id", "embedding"), topk.F.col("id") % 20 == 0).count() == 0


def test_maxscore_probes_few_postings_and_loses_nothing():
    """Where a few terms carry the scores, the others are probed for few vectors only."""
    rng = np.random.default_rng(2)
    vectors = np.floor(rng.normal(size=(5000, 32)) * np.r_[np.full(6, 60), np.full(26, 2)]).astype(np.int64)
    rows, queries = np.arange(5000), vectors[::500]
    counts: dict = {}
    found = topk.maxscore(rows, rows * 10, vectors, rows[::500], queries, 20, counts)
    for i, query in zip(rows[::500], queries, strict=True):
        scores = vectors @ query
        want = [r for r in np.lexsort((rows, -scores)) if r != i][:20]
        assert [(v, s) for q, v, s in found if q == i] == [(r * 10, scores[r]) for r in want]
    assert counts["traversed"] < 0.1 * counts["all"] and counts["traversed"] + counts["probed"] < 0.4 * counts["all"]


PAGE = "<html>" + "x\r\n\r\ny " * 40 + "é</html>"


def test_archives_round_trip(spark, tmp_path):
    rows = [(5, "http://a/1", PAGE), (2, "http://a/2", PAGE), (9, None, PAGE), (3, "u\r\nX: y", "small"), (4, "", "small"), (6, "http://e", None), (7, "http://e", ""), (8, "http://f", "\r\n\r\n" * 60), (1, "x", "WARC/1.1\r\n\r\n" * 20)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, name int")
    path = str(tmp_path / "w")
    warc.write(df, path)
    captures = warc.assemble(warc.read(spark, path))
    nested = {r.metadata.fields.strip(): r for r in captures.collect()}
    assert bytes(nested["page-id: 2"].response.payload).decode() == PAGE
    assert nested["page-id: 3"].request.target_uri == "u%0D%0AX: y" and nested["page-id: 5"].response.type == "revisit"
    names, want = duck(warc.OP8_SQL, "pages", "page_id BIGINT, url VARCHAR, html VARCHAR", rows)
    assert sorted((tuple(r) for r in warc.page_records(captures).select(*names).collect()), key=str) == want


def test_archives_of_repeats_and_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", PAGE)] * 2 + [(None, "u", PAGE), (2, "u", PAGE)], "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "r"))
    rows = warc.page_records(warc.assemble(warc.read(spark, str(tmp_path / "r")))).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in rows), key=str) == [(1, "response", None), (1, "response", None), (2, "revisit", 1), (None, "revisit", 1)]
    assert all(r.payload_digest == hashlib.sha256(PAGE.encode()).hexdigest() and r.payload_bytes == len(PAGE.encode()) for r in rows)
    warc.write(df.limit(0), str(tmp_path / "e"))
    assert warc.page_records(warc.assemble(warc.read(spark, str(tmp_path / "e")))).count() == 0


def test_captures_without_all_records(spark):
    """A capture may lack its request or metadata; a request alone is no capture."""
    rows = [
        ("response", "<a>", None, "u", "d", None, 1, "s", b"x"),
        ("request", "<a:r>", "<a>", "u", None, None, None, None, None),
        ("revisit", "<b>", None, "v", "d", None, None, None, None),
        ("metadata", "<b:m>", "<b>", None, None, "page-id: 4", None, None, None),
        ("request", "<c:r>", "<c>", "w", None, None, None, None, None),
        ("warcinfo", "<i>", None, None, None, None, None, None, None),
    ]
    found = {r.capture: r for r in warc.assemble(spark.createDataFrame(rows, warc._RECORD)).collect()}
    assert set(found) == {"<a>", "<b>"}
    assert found["<a>"].metadata is None and found["<a>"].request.target_uri == "u" and bytes(found["<a>"].response.payload) == b"x"
    assert found["<b>"].request is None and found["<b>"].metadata.fields == "page-id: 4"


def test_records_in_any_pieces():
    data = "".join(f"WARC/1.1\r\nContent-Length: {n}\r\n\r\n{'x' * n}\r\n\r\n" for n in (0, 3, 50)).encode()
    for step in (1, 7, 1000):
        found = list(warc.records(("f", data[i : i + step]) for i in range(0, len(data), step)))
        assert [len(block) for _, _, block in found] == [0, 3, 50]
    with pytest.raises(ValueError):
        list(warc.records([("f", data[:-10])]))
