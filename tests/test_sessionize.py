"""The windows of the sessioniser against a plain walk over the events."""

import random

from trailmill.operators import sessionize as S

SCHEMA = "session_id long, seq long, ts_ms long, event_name string, product_handle string, query string, collection_handle string"


def walk(events, dwell):
    rows, prev, prev_product, last, one, name1, two = [], None, "", 0, "", "", ""
    for _, _, ts, name, product, query, collection in events:
        action = S.EVENT_ACTION.get(name, "Other")
        if product:
            page = f"/products/{product}"
        elif action == "explore-search" and query:
            page = f"/search?q={query}"
        elif action == "explore-goto" and collection:
            page = f"/collections/{collection}"
        else:
            page = ""
        repeat = bool(page) and page == one and name == name1
        if action != "Other":
            if repeat:
                action = "explore-stay"
            elif page and page == two and page != one:
                action = "explore-back"
        emitted = rows[-1][1] if rows else None
        if not repeat and prev is not None and ts - prev > dwell and action != "explore-stay" and emitted != "explore-stay":
            rows.append([prev + 1, "explore-stay", f"/products/{prev_product}" if prev_product else ""])
            emitted = "explore-stay"
        if repeat and emitted == "explore-stay":
            rows[-1][0] = ts
        else:
            rows.append([ts, action, page])
        prev, prev_product, last = ts, product, ts
        two, one, name1 = one, page, name
        if action == "checkout":
            break
    return [*map(tuple, rows), (last + 1, "terminate", "")]


def test_rows_equal_the_walk(spark):
    random.seed(3)
    names = [*S.EVENT_ACTION, "entity_impression"]
    events = []
    for session in range(400):
        ts = 0
        for seq in range(random.randint(1, 9)):
            ts += random.choice([0, 5, 5, 30])
            name = random.choice(names)
            events.append((session, seq, ts, name, random.choice(["a", "b", ""]), random.choice(["q", ""]), random.choice(["c", ""])))
    got = {}
    for r in S.sessions(spark.createDataFrame(events, SCHEMA), 10).orderBy("session_id", "ord").collect():
        got.setdefault(r.session_id, []).append((r.ts_ms, r.action, r.page))
    for session in range(400):
        assert got[session] == walk([e for e in events if e[0] == session], 10), [e for e in events if e[0] == session]


def test_empty_and_unplaced(spark):
    df = spark.createDataFrame([(None, 0, 1, "page_viewed", "", "", ""), (1, 0, None, "page_viewed", "", "", "")], SCHEMA)
    assert S.sessions(df).count() == 0
    assert S.click_action is not None and df.limit(0).count() == 0


def test_persona_split(spark):
    rows = [(1, 0, 0, ""), (1, 1, 1, "x"), (1, 2, 2, ""), (1, 3, 3, "y"), (2, 0, 0, "")]
    df = spark.createDataFrame(rows, "session_id long, seq long, ts_ms long, persona string")
    got = {(r.session_id, r.seq): r.session_part for r in S.split_by_persona(df).collect()}
    assert got[(1, 0)] == "1::p::0"
    assert got[(1, 1)] == got[(1, 2)] == "1::px::1"
    assert got[(1, 3)] == "1::py::2"
    assert got[(2, 0)] == "2"
