"""A warehouse and a polled service for the source tests; workers import them by name."""

import json
import os

PLACE = "/tmp/trailmill-fakes"


def query(sql, parameters):
    """Runs a query over one table of rows; the text and the parameters are kept beside it."""
    import duckdb

    with open(f"{PLACE}-log", "a") as f:
        f.write(json.dumps([sql, parameters]) + "\n")
    con = duckdb.connect()
    con.execute("CREATE TABLE facts (shop_id BIGINT, session_id VARCHAR, n BIGINT)")
    con.execute("INSERT INTO facts SELECT i % 3, 's' || (i % 10), i FROM range(60) t(i)")
    text = sql.replace("IN UNNEST(@session_ids)", "IN (SELECT unnest($session_ids))")
    out = con.execute(text, parameters) if parameters else con.execute(text)
    names = [d[0] for d in out.description]
    return [dict(zip(names, row, strict=True)) for row in out.fetchall()]


def now():
    with open(f"{PLACE}-now") as f:
        return int(f.read())


def fetch(begin, end, page):
    """Two pages a window; a record of the window before comes once more."""
    with open(f"{PLACE}-polls", "a") as f:
        f.write(f"{begin} {end} {page}\n")
    rows = [{"link": f"l{begin}", "n": 1}, {"session_id": f"s{begin}", "link": ""}, {"id": "", "n": begin}]
    again = [{"link": f"l{begin - (end - begin)}", "n": 1}]
    return [rows, again][page] if page < 2 else []


def clear():
    for name in ("log", "now", "polls"):
        if os.path.exists(f"{PLACE}-{name}"):
            os.remove(f"{PLACE}-{name}")
