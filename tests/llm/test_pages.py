"""Archives, url rules and shards."""

import gzip
import hashlib

import pytest
from seqlattice.llm import sharding, urlfilter, warc
from seqlattice.llm.queries import RULES, SHARDS

LONG = "<html>" + "x" * 300


def pages(spark):
    rows = [
        (5, "http://a.org/", LONG),
        (3, "http://b.org/ä b", LONG),
        (9, None, LONG),
        (1, "http://c.org/", "short"),
        (2, "http://d.org/", "short"),
        (4, "http://e.org/\r\nX: y", None),
        (6, "http://f.org/", ""),
        (7, "http://g.org/", "é" * 50),
        (8, "http://g.org/", "é" * 50),
        (None, "http://h.org/", LONG),
        (3, "http://b.org/again", LONG),
        (10, "u", "big\r\n\r\n" * 200_000),
    ]
    return rows, spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string")


def test_archives_round_trip(spark):
    rows, df = pages(spark)
    index = warc.write(df.repartition(3))
    got = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_digest"], r["payload_bytes"], r["payload"]) for r in warc.read(index).collect()), key=str)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = min(p for p, _, h in rows if (h or "") == (html or "") and p is not None)
        revisit = len(data) >= 100 and page != first
        want.append((page or 0, "revisit" if revisit else "response", first if revisit else None, hashlib.sha256(data).hexdigest(), len(data), None if revisit else bytearray(data)))
    assert got == sorted(want, key=str)


def test_index_names_every_record(spark):
    """Each entry is a gzip member of its own; a selection reads its records only."""
    rows, df = pages(spark)
    index = warc.write(df)
    entries = index.collect()
    assert len(entries) == len(rows)
    for r in entries:
        with open(r["file"].removeprefix("file:"), "rb") as f:
            f.seek(r["offset"])
            member = f.read(r["length"])
        assert gzip.decompress(member).startswith(b"WARC/1.1\r\n") and gzip.decompress(member).endswith(b"\r\n\r\n")
        assert warc.decode_record(member)["payload_digest"] == r["digest"]
    assert [r["page_id"] for r in warc.read(index.filter("page_id = 7")).collect()] == [7]
    assert warc.read(warc.write(df.filter("page_id > 99"))).collect() == []


def test_damage_is_noticed():
    member = warc.encode_record(1, "u", b"payload", hashlib.sha256(b"other").hexdigest(), None)
    with pytest.raises(ValueError, match="damaged"):
        warc.decode_record(member)


URLS = [
    None,
    "",
    "no scheme/es/",
    "http://",
    "http://org",
    "http://org/",
    "http://Example.ORG/es/x",
    "http://a.b.example.org/es/?q",
    "http://a.example.org/en/12#f",
    "http://a.example.org/en/2",
    "http://example.com/fr/1",
    "http://notexample.org/es/",
    "http://com/de/",
    "http://x.com/de",
    "ftp://x.com/fr/a?/de/",
    "http://ÄA.com/fr/",
    "http://a..com/fr/",
    "http://x.com?/fr/",
    "http://" + "a." * 3000 + "org/es/",
    "x://y://z.org/",
    "http://multi\nline.org/a\nb",
]


def expected(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


@pytest.mark.parametrize("rules", [RULES, RULES + [("org", "/es/", "allow"), ("b.example.org", "/", "block"), ("org", "/", "block"), ("example.org", "/es/x", "allow"), ("example.org", "", "block")]])
def test_url_rules(spark, rules):
    df = spark.createDataFrame([(k, u, "v") for k, u in enumerate(URLS)] + [(None, "http://x.com/fr/", "v"), (3, "http://", "v")], "page_id long, url string, verdict string")
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("net", None, "allow")], "host string, path string, verdict string")
    got = sorted(((r[0], *r[1:]) for r in map(tuple, urlfilter.judge(df, table).collect())), key=str)
    want = [(k, *expected(u, rules)) for k, u in enumerate(URLS)] + [(None, *expected("http://x.com/fr/", rules)), (3, *expected("http://", rules))]
    assert got == sorted(want, key=str)


def test_url_rules_of_nothing(spark):
    df = spark.createDataFrame([(1, "http://x.com/fr/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in urlfilter.judge(df, none, default="block").collect()] == [(1, "x.com", "/fr/", None, "block")]
    assert urlfilter.judge(df.filter("page_id > 1"), none).collect() == []


def slow_fill(names, slots):
    """The table, one turn after the other, from each shard's written-out order."""
    orders = []
    for n in names:
        offset, skip = sharding._number("offset:" + n) % slots, sharding._number("skip:" + n) % (slots - 1) + 1
        orders.append([(offset + k * skip) % slots for k in range(slots)])
    owner = {}
    while len(owner) < slots:
        for i, order in enumerate(orders):
            free = next((s for s in order if s not in owner), None)
            if free is not None:
                owner[free] = i
    return [owner[s] for s in range(slots)]


@pytest.mark.parametrize("names,slots", [(["a"], 2), (["a", "b", "c"], 3), (list("abcdefg"), 211)])
def test_table_is_filled_in_turns(names, slots):
    assert sharding.fill(names, slots) == slow_fill(names, slots)


def test_table_is_even_and_stable():
    owner = sharding.fill(SHARDS)
    sizes = [owner.count(k) for k in range(len(SHARDS))]
    assert max(sizes) - min(sizes) <= 1
    fewer = sharding.fill(SHARDS[:-1])
    moved = sum(a != b for a, b in zip(owner, fewer) if a != len(SHARDS) - 1)
    assert moved < 0.1 * len(owner)


def test_placement(spark):
    rows = [(1, "a"), (2, "b"), (1, "c"), (None, "d")]
    df = spark.createDataFrame([(k, t, "mine") for k, t in rows], "key long, t string, shard string")
    names = ["s0", "s1", "s2"]
    got = sharding.place(df, "key", names, 101)
    assert got.columns == ["key", "t", "slot", "shard"]
    owner = sharding.fill(names, 101)
    for r in got.collect():
        slot = int(hashlib.md5(str(r["key"]).encode() if r["key"] is not None else b"").hexdigest()[:15], 16) % 101
        assert (r["slot"], r["shard"]) == (slot, names[owner[slot]])
    assert got.count() == 4 and sharding.place(df.filter("key > 5"), "key", names, 101).collect() == []
    for wrong in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill(wrong, 101)
    with pytest.raises(ValueError):
        sharding.fill(names, 100)
