"""Operators over pages and conversations, and the pipeline."""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL
from llm_tables import odd_documents  # noqa: F401
from skyvane.llm import chat_format, url_filter, warc
from skyvane.llm.queries import QUERIES

SAID = "\\### Assistant: </turn> ok"


def digest_by_hand(turns: list) -> tuple:
    """``turns`` are (turn, role, text); nulls come first."""
    ordered = sorted(turns, key=lambda t: tuple((x is not None, x if x is not None else 0) for x in t))
    whole = "".join(f"{role or ''}\n{text or ''}\n" for _, role, text in ordered)
    loss = "".join(text or "" for _, role, text in ordered if role == "assistant")
    return (
        len(turns),
        hashlib.sha256(whole.encode()).hexdigest(),
        len(loss),
        hashlib.sha256(loss.encode()).hexdigest(),
    )


def test_chats_read_back(spark):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text))
    turns[-7] = [(0, "user", SAID), (1, "assistant", SAID)]
    rows = QUERIES["op7_chat_format"](spark, SMALL).collect()
    assert {r.conv_id for r in rows} == set(turns) and len(rows) == len(turns)
    for r in rows:
        found = (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256)
        assert found == digest_by_hand(turns[r.conv_id])


def test_chats_of_odd_rows_and_one_long_conversation(spark):
    rows = [(5, k, "assistant" if k % 2 else "user", f"é{k} <\\> #") for k in range(5000)]
    rows += [
        (1, None, None, None),
        (1, 0, "a:b\\", "x\\"),
        (1, 0, "a:b\\", "x\\"),
        (2, 3, "assistant", ""),
        (None, 1, "user", "no id"),
        (None, 0, "assistant", "</turn>\n### user: "),
        (3, 1, "assistant", "long " * 400_000),
    ]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = defaultdict(list)
    for conv, *turn in rows:
        turns[conv].append(tuple(turn))
    pieces = chat_format.formatted(given.selectExpr("*", "'x' AS part").repartition(7))
    found = chat_format.digests(pieces).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in found} == {
        conv: digest_by_hand(own) for conv, own in turns.items()
    }
    text = "".join(
        r.formatted for r in sorted(pieces.where("conv_id = 1").collect(), key=lambda r: (r.part, r.seq))
    )
    assert text.count("</turn>\n") == 3 and next(r for r in found if r.conv_id == 1).formatted_chars == len(text)
    assert chat_format.digests(chat_format.formatted(given.where("false"))).collect() == []


def pieces_of(conversations):
    """(conv_id, batches of one megabyte) -> batches as ``formatted`` gives them."""
    line = b"### user: " + b"x" * (1 << 20) + b"</turn>\n"
    for conv_id, n in conversations:
        for k in range(n):
            yield pa.RecordBatch.from_pydict(
                {
                    "conv_id": pa.array([conv_id]),
                    "part": pa.array([0], pa.int32()),
                    "seq": pa.array([k]),
                    "formatted": [line.decode()],
                    "spans": pa.array(
                        [[]], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                    ),
                }
            )


@pytest.mark.parametrize("held", [8 << 20, 1 << 30])
def test_long_conversations_behind_others_are_hashed_in_linear_time(held, monkeypatch):
    """Four hundred batches of one conversation behind another one: they travel as they come, or
    are hashed once, and what is held is never copied."""
    monkeypatch.setattr(chat_format, "HELD_BYTES", held)
    added = []
    add = chat_format.Digest.add
    monkeypatch.setattr(
        chat_format.Digest, "add", lambda self, piece, spans: added.append(1) or add(self, piece, spans)
    )
    out, most = [], 0
    for batch in chat_format._digested_inside(pieces_of([(1, 2), (2, 400), (3, 3), (4, 1)])):
        pa_held = pa.total_allocated_bytes()
        most = max(most, pa_held)
        out += [(row["conv_id"], row["n_turns"]) for row in batch.drop_columns(["formatted"]).to_pylist()]
    travelling = [conv for conv, n in out if n is None]
    if held == 8 << 20:
        assert travelling == [1] * 2 + [2] * 400 + [4] and (3, 3) in out
        assert len(added) == 3 and most < 64 << 20
    else:
        assert travelling == [1] * 2 + [4] and {(2, 400), (3, 3)} < set(out)
        assert len(added) == 403


def test_one_conversation_of_many_batches_behind_another_one(spark, monkeypatch):
    rows = [(1, k, "user", "first " * 50) for k in range(50)]
    rows += [(2, k, "assistant" if k % 2 else "user", f"{k} word <#> " * 40) for k in range(4000)]
    rows += [(k, 0, "assistant", "brief") for k in range(3, 40)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = defaultdict(list)
    for conv, *turn in rows:
        turns[conv].append(tuple(turn))
    monkeypatch.setattr(chat_format, "HELD_BYTES", 100_000)
    monkeypatch.setattr(chat_format, "PIECE_BYTES", 20_000)
    found = chat_format.digests(chat_format.formatted(given.coalesce(1))).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in found} == {
        conv: digest_by_hand(own) for conv, own in turns.items()
    }


def test_control_strings_never_stand_in_texts():
    buffer, ends, spans = chat_format.assemble(["user"], pa.array([SAID]))
    raw = buffer.tobytes()
    assert raw == b"### user: \\\\\\#\\#\\# Assistant: \\</turn> ok</turn>\n"
    reader = chat_format.PieceReader(np.frombuffer(raw, dtype=np.uint8))
    assert list(reader.turns()) == [(b"user", SAID.encode())]


def rule_by_hand(host: str, path: str) -> tuple:
    fitting = [
        (len(top + start), top + start, action)
        for action, top, start in url_filter.RULES
        if (host == top or host.endswith("." + top)) and path.startswith(start)
    ]
    return max(fitting)[1:] if fitting else (None, None)


def parts_by_hand(url: str | None) -> tuple:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[cut:]
    stop = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return rest[:cut].lower(), path[:stop]


def test_url_rules(spark):
    more = [
        (-1, "HTTP://WWW.Example.COM/en/x?y#z", None),
        (-2, None, ""),
        (-3, "no host", "<a href='//b.net/'>"),
        (-4, "x://example.net?/es/", ""),
        (-5, "a://b://c.com/d", ""),
        (-6, "http://com", ""),
        (-7, "http://notnet/es/", ""),
        (None, "http://a.org/\n1", None),
        (-1, "HTTP://WWW.Example.COM/en/x?y#z", None),
    ]
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html")
    given = pages.union(spark.createDataFrame(more, pages.schema)).selectExpr("*", "'k' AS kind")
    urls = {r.page_id: r.url for r in given.collect()}
    rows = url_filter.verdicts(given).collect()
    assert len(rows) == given.count()
    for r in rows:
        assert (r.host, r.path) == parts_by_hand(urls[r.page_id])
        rule, action = rule_by_hand(r.host, r.path)
        assert r.rule == rule and (action is None or r.verdict == action)
    assert len(QUERIES["op8_url_filter"](spark, SMALL).collect()) == pages.count()
    assert url_filter.verdicts(given.where("false")).collect() == []


def test_trust_and_distrust_follow_links(spark):
    def links(*hosts):
        return "".join(f'<a HREF="https://{host}/">x</a>' for host in hosts)

    rows = [
        (1, "http://good.com/", links("friend.org", "good.com")),
        (2, "http://bad.net/es/", links("good.com")),
        (3, "http://farm.org/", links("bad.net")),
        (4, "http://friend.org/", links("bad.net", "good.com", "good.com")),
        (5, "http://alone.org/", "<a href='/x'>"),
    ]
    given = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.host: r for r in url_filter.verdicts(given).collect()}
    # Brute force on the same graph: trust by columns, distrust by rows of the link matrix.
    hosts = ["good.com", "bad.net", "farm.org", "friend.org", "alone.org"]
    edges = [(0, 3), (1, 0), (2, 1), (3, 1), (3, 0)]
    link = np.zeros((5, 5))
    for a, b in edges:
        link[a, b] = 1
    share = link / np.maximum(link.sum(axis=1, keepdims=True), 1)
    allowed, blocked = np.array([1.0, 0, 0, 0, 0]), np.array([0.0, 1, 0, 0, 0])
    trust, distrust = allowed, blocked
    for _ in range(400):
        trust = allowed + url_filter.FOLLOW * trust @ share
        distrust = blocked + url_filter.FOLLOW * (1 - allowed - blocked) * (share @ distrust)
    for host, t, d in zip(hosts, trust, distrust):
        # What the last round may still have moved spreads on in later ones.
        assert found[host].trust == pytest.approx(t, abs=2e-3)
        assert found[host].distrust == pytest.approx(d, abs=2e-3)
    assert found["farm.org"].verdict == "block"
    assert found["alone.org"].verdict == "allow" and found["good.com"].verdict == "allow"


def test_trust_runs_until_it_is_settled_or_raises(spark):
    """Two allowed hosts that link to each other pass a share of 0.85 on for ever."""
    rows = [
        (1, "http://a.com/", '<a href="//b.com/">x</a>'),
        (2, "http://b.com/", '<a href="//a.com/">x</a>'),
    ]
    given = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in url_filter.verdicts(given).collect():
        assert r.trust == pytest.approx(1 / (1 - url_filter.FOLLOW), abs=1e-3)
    with pytest.raises(RuntimeError, match="20 rounds"):
        url_filter.verdicts(given, rounds=20)


@pytest.fixture
def small_partitions(spark):
    """Sizes scaled down, so that a small hot key counts as a large one; nothing is broadcast."""
    from test_skew import SMALL_PARTITIONS

    before = {name: spark.conf.get(name, None) for name in SMALL_PARTITIONS}
    for name, value in SMALL_PARTITIONS.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_equal_payloads_are_split(spark, small_partitions):
    """Nine in ten pages hold the same payload; nothing is broadcast."""
    from test_skew import executed

    pages = spark.range(0, 40_000, 1, 8).selectExpr(
        "id AS page_id",
        "concat('http://h/', id) AS url",
        "IF(id % 10 > 0, repeat('same', 20), sha2(CAST(id DIV 20 AS STRING), 256)) AS html",
    )
    shown = []
    write = warc.stored

    def watched(df, purpose):
        if purpose == "warc-index":
            shown.append(executed(df)[0])
        return write(df, purpose)

    warc.stored = watched
    try:
        index = warc.written(pages).collect()
    finally:
        warc.stored = write
    assert "skew=true" in shown[0] and len(index) == 40_000
    assert sum(r.record_type == "response" for r in index) == 1 + 2000


def test_hot_and_hub_hosts_are_split(spark, small_partitions):
    """Nine in ten pages are of one host, which links to all others; nothing is broadcast."""
    from test_skew import executed

    pages = spark.range(0, 60_000, 1, 8).selectExpr(
        "id AS page_id",
        "concat('http://', IF(id % 10 > 0, 'hot', concat('h', id)), '.org/', id) AS url",
        "IF(id % 10 = 1, concat('<a href=\"//h', id - 1, '.org/\">'), '') AS html",
    )
    host, path = url_filter.url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"), url_filter._links())
    n_links = url_filter._edges(url_filter._with_rule(parts, url_filter.RULES)).count()
    shown, rows = executed(url_filter.verdicts(pages))
    assert "skew=true" in shown and len(rows) == 60_000 and n_links == 6000
    assert {r.verdict for r in rows} == {"allow"}


def test_a_farm_is_blocked_however_many_link_there(spark):
    def links(*hosts):
        return "".join(f'<a href="https://{host}/">x</a>' for host in hosts)

    rows = [(1, "http://bad.net/es/", ""), (2, "http://worse.net/fr/", ""), (3, "http://good.com/", "")]
    rows += [(10 + k, f"http://farm{k}.org/", links("bad.net", "worse.net")) for k in range(100)]
    rows += [(200, "http://next.org/", links("farm1.org", "farm2.org"))]
    others = [f"site{k}.org" for k in range(9)]
    rows += [(201, "http://list.org/", links("bad.net", *others))]
    rows += [(202, "http://half.org/", links("bad.net", "good.com"))]
    given = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.host: r for r in url_filter.verdicts(given).collect()}
    for k in range(100):
        assert found[f"farm{k}.org"].verdict == "block"
        assert found[f"farm{k}.org"].distrust == pytest.approx(0.85)
    assert found["next.org"].verdict == "block"
    assert found["list.org"].verdict == "allow" and found["list.org"].distrust == pytest.approx(0.085)
    assert found["half.org"].verdict == "allow"
    # Fewer linkers give the same verdict and blame.
    few = {r.host: r for r in url_filter.verdicts(given.where("page_id < 12 OR page_id = 201")).collect()}
    for host in ("farm0.org", "farm1.org", "list.org"):
        assert (few[host].verdict, few[host].distrust) == (
            found[host].verdict,
            pytest.approx(found[host].distrust),
        )


def test_archives_read_back(spark):
    more = [
        (-1, None, None),
        (-2, "http://a/\r\nb", ""),
        (-3, "http://é/", "same"),
        (-4, "u", "same"),
        (-4, "u", "same"),
        (None, "n", "same"),
        (None, "m", "alone"),
        (-5, "big", "x" * 3_000_000),
    ]
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html")
    given = pages.union(spark.createDataFrame(more, pages.schema)).selectExpr("*", "'f' AS file")
    payloads = [(r.page_id, (r.html or "").encode()) for r in given.collect()]
    newest = {}
    for page, payload in payloads:
        old = newest.get(payload)
        newest[payload] = page if old is None else max(old, page or old)
    expected = sorted(
        (
            str(page),
            len(payload),
            base64.b32encode(hashlib.sha1(payload).digest()).decode(),
            "response" if newest[payload] == page else "revisit",
            str(None if newest[payload] == page else newest[payload]),
        )
        for page, payload in payloads
    )
    index = warc.written(given, file_bytes=20_000)
    assert index.select("file").distinct().count() > 1
    rows = warc.read(index).collect()
    assert expected == sorted(
        (str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in rows
    )
    assert all((r.payload is None) == (r.record_type == "revisit") for r in rows)
    few = warc.read(index.where("page_id = -5")).collect()
    assert [r.payload for r in few] == [b"x" * 3_000_000] and few[0].url == "big"
    responses = warc.read(warc.written(given, least_revisit_bytes=5)).where("record_type = 'revisit'")
    assert responses.where("payload_bytes < 5").count() == 0
    assert warc.read(warc.written(given.where("false"))).collect() == []
    assert len(QUERIES["op9_warc"](spark, SMALL).collect()) == pages.count()


def test_pipeline_keeps_what_it_should(spark, odd_documents):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert 0 < len(rows) < documents.count()
    assert [c for c in rows[0].asDict()] == [*documents.columns, "weight"]
    assert len({r.doc_id for r in rows}) == len(rows) and all(r.weight >= 1 for r in rows)
    for given in (odd_documents, odd_documents.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, given, SMALL)
            assert set(given.columns) <= set(kept.columns), name
            assert kept.count() <= given.count()
    first = corpus_pipeline.deduplicated(spark, odd_documents, SMALL)
    ids = [r.doc_id for r in first.collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(None) == 2


def test_stages_keep_columns_with_clashing_names(spark, odd_documents):
    """Names that stages and operators use inside, also in another case."""
    names = ["Weight", "_stage_place", "document", "lang_pred", "place", "Matches", "probability"]
    given = odd_documents.drop("score", "kept", "node", "matches", "row", "topic", "weight").selectExpr(
        "*", *(f"CONCAT('{name} of ', doc_id) AS `{name}`" for name in names)
    )
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, given, SMALL)
        own = [c for c in given.columns if name != "mixing" or c != "Weight"]
        assert kept.columns == [*own, "weight"] if name == "mixing" else kept.columns == own, name
        for row in kept.select("doc_id", *(c for c in names if c in own)).collect():
            for c in row.asDict():
                if c != "doc_id" and row.doc_id is not None:
                    assert row[c] == f"{c} of {row.doc_id}", name
