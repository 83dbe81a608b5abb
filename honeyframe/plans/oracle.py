"""The same relations and queries in DuckDB's SQL, written apart from the operators they are compared with."""

from __future__ import annotations

from honeyframe.functions.geometry import Coord
from honeyframe.sources.fixtures import BASE_NS, BLOCKERS, HOUR_NS

#: The child of a super-hexagon that has residue (3q + r) mod 7, as an offset from its center.
CHILD_OFFSETS = ((0, 0), (0, 1), (1, -1), (1, 0), (-1, 0), (-1, 1), (0, -1))
#: Shifts and masks that spread 21 bits three apart.
SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))
MONTH_NS = 30 * 24 * HOUR_NS
WEEK_NS = 604_800_000_000_000


def dist(q1: str, r1: str, q2, r2) -> str:
    return f"((abs({q1} - ({q2})) + abs({r1} - ({r2})) + abs(({q1}) - ({q2}) + ({r1}) - ({r2}))) // 2)"


def key(q: str, r: str) -> str:
    def spread(x: str) -> str:
        z = f"(CASE WHEN ({x}) >= 0 THEN 2 * ({x}) ELSE -2 * ({x}) - 1 END)::BIGINT"
        out = f"({z})"
        for shift, mask in SPREAD:
            out = f"(({out} | ({out} << {shift})) & {mask})"
        return out

    return f"({spread(q)} | ({spread(r)} << 1) | ({spread(f'-({q}) - ({r})')} << 2))"


def spiral(q: str, r: str, c: Coord | tuple[str, str] = (0, 0)) -> str:
    dq, dr = f"({q} - ({c[0]}))", f"({r} - ({c[1]}))"
    k = dist(q, r, *c)
    pos = f"CASE WHEN {dq} = {k} AND {dr} > -{k} THEN -{dr} WHEN {dr} = -{k} AND {dq} > 0 THEN 2 * {k} - {dq} WHEN -{dq} - {dr} = {k} AND {dq} > -{k} THEN 2 * {k} - {dq} WHEN {dq} = -{k} AND {dr} < {k} THEN 3 * {k} + {dr} ELSE 5 * {k} + {dq} END"
    return f"(CASE WHEN {k} = 0 THEN 0 ELSE 1 + 3 * {k} * ({k} - 1) + {pos} END)"


def floor_div(x: str, by) -> str:
    return f"(({x}) // {by} - CASE WHEN ({x}) % {by} < 0 THEN 1 ELSE 0 END)"


def inverse(source: str, n: str, keep: str) -> str:
    """SELECT of ``keep``, q and r with the coordinate at place ``n`` of the spiral."""
    k = f"(CASE WHEN {n} = 0 THEN 0 ELSE CAST(floor((sqrt(12.0 * {n} - 3) + 3) / 6) AS BIGINT) END)"
    return f"""SELECT {keep},
      CAST(CASE WHEN _k = 0 THEN 0 WHEN _s = 0 THEN _k WHEN _s = 1 THEN _k - _j WHEN _s = 2 THEN -_j WHEN _s = 3 THEN -_k WHEN _s = 4 THEN _j - _k ELSE _j END AS INT) AS q,
      CAST(CASE WHEN _k = 0 THEN 0 WHEN _s = 0 THEN -_j WHEN _s = 1 THEN -_k WHEN _s = 2 THEN _j - _k WHEN _s = 3 THEN _j WHEN _s = 4 THEN _k ELSE _k - _j END AS INT) AS r
    FROM (SELECT *, CASE WHEN _k = 0 THEN 0 ELSE _p // _k END AS _s, CASE WHEN _k = 0 THEN 0 ELSE _p % _k END AS _j
      FROM (SELECT *, CASE WHEN _k = 0 THEN 0 ELSE {n} - 1 - 3 * _k * (_k - 1) END AS _p FROM (SELECT *, {k} AS _k FROM {source})))"""


_START = f"({BASE_NS} + doc_id * {HOUR_NS})"
_FROM = f"CASE WHEN doc_id % 5 <> 0 THEN {_START} END"
_TO = f"CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN {_START} + {MONTH_NS} END"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "placed": ((), f"SELECT *, {key('q', 'r')} AS key FROM ({inverse('documents', 'doc_id', '* EXCLUDE (_k, _p, _s, _j)')})"),
    "coords": (("placed",), "SELECT doc_id, q, r, key FROM placed"),
    "cells": (("placed",), f"""SELECT q, r, key, text AS raw_content, source AS source_id, (doc_id % 8) / 8.0::DOUBLE AS confidence, {_START} AS created_at, {_FROM} AS valid_from, {_TO} AS valid_to, p.doc_id, doc_id + 1 AS commit_seq,
      list_filter([lang, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 1 THEN 'quality' END], lambda t: t IS NOT NULL) AS tags
      FROM placed p LEFT JOIN labels USING (doc_id)"""),
    "versions": ((), f"""SELECT q, r, {key('q', 'r')} AS key, event_id + 1 AS commit_seq, event_type = 'error' AS deleted, event_type AS raw_content, epoch_us(ts) * 1000 AS wall_ns
      FROM ({inverse('events', 'user_id', 'event_id, event_type, ts')})"""),
    "edges": (("coords",), """SELECT a.q AS from_q, a.r AS from_r, a.key AS from_key, b.q AS to_q, b.r AS to_r, b.key AS to_key, relation, weight FROM (
        SELECT doc_id AS a, doc_id + s AS b, 'evidence-route' AS relation, w AS weight FROM documents, (VALUES (1, 1.0::DOUBLE), (8, 3.0::DOUBLE)) t(s, w)
        UNION ALL SELECT doc_id, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id), 'same-source', 1 + (doc_id % 4) / 4.0::DOUBLE FROM documents
      ) e JOIN coords a ON a.doc_id = e.a JOIN coords b ON b.doc_id = e.b"""),
    "seams": (("coords",), f"""SELECT lpad(x.doc_id::VARCHAR, 10, '0') AS id, x.doc_id, a.q AS a_q, a.r AS a_r, a.key AS a_key, b.q AS b_q, b.r AS b_r, b.key AS b_key, 'supersedes' AS seam_type,
        CASE WHEN x.doc_id % 2 = 0 THEN 'resolved' ELSE '' END AS resolution_status, {_FROM.replace('doc_id', 'x.doc_id')} AS valid_from, {_TO.replace('doc_id', 'x.doc_id')} AS valid_to, 'scan-' || (x.doc_id % 4) AS source_id, x.doc_id + 1 AS commit_seq
      FROM (SELECT doc_id, lag(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS older FROM documents) x JOIN coords a ON a.doc_id = x.older JOIN coords b ON b.doc_id = x.doc_id"""),
    "facets": (("placed",), """SELECT q, r, key, doc_id, f AS facet_id, CASE WHEN f = 1 THEN text ELSE lang END AS derived_content, sha256(text) AS derivation_hash
      FROM placed, (VALUES (1), (4)) t(f) WHERE f = 1 OR doc_id % 2 = 0"""),
    "vectors": ((), f"SELECT *, {key('q', 'r')} AS key FROM ({inverse('embeddings', 'vec_id', 'vec_id, embedding, label')})"),
    "changelog": (("versions",), "SELECT commit_seq AS seq, wall_ns, CASE WHEN deleted THEN 6 ELSE 1 END AS op, q, r, key, CASE WHEN NOT deleted THEN raw_content END AS payload, CASE WHEN NOT deleted THEN sha256(raw_content) END AS hash, CASE WHEN deleted THEN 0 ELSE strlen(raw_content) END AS encoded_len FROM versions"),
    "live": (("versions",), "SELECT * FROM versions WHERE NOT deleted QUALIFY row_number() OVER (PARTITION BY key ORDER BY commit_seq DESC) = 1"),
}
# A snapshot first resolves the last version and then drops deletions.
VIEWS["live"] = (("versions",), "SELECT * FROM (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY key ORDER BY commit_seq DESC) = 1) WHERE NOT deleted")
_BLOCK = " + ".join(f"{x}::BIGINT * {m}" for x, m in zip(("q", "r"), BLOCKERS, strict=False))
VIEWS["blockers"] = (("coords",), f"SELECT q, r FROM coords WHERE (({_BLOCK}) % {BLOCKERS[2]} + {BLOCKERS[2]}) % {BLOCKERS[2]} = 0")


def sql(body: str, *views: str, more: str = "", recursive: bool = False) -> str:
    """``body`` after the relations it names and those they need; ``more`` are further common table expressions."""
    order: list[str] = []

    def need(name: str) -> None:
        for x in VIEWS[name][0]:
            need(x)
        if name not in order:
            order.append(name)

    for v in views:
        need(v)
    parts = [f"{v} AS ({VIEWS[v][1]})" for v in order] + ([more] if more else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)}\n{body}" if parts else body


def disk(center: Coord, low: int, high: int) -> str:
    """A table expression of the coordinates at distance low..high: q, r, ring, n (their place)."""
    first = 0 if low <= 0 else 1 + 3 * (low - 1) * low
    last = 3 * high * (high + 1)
    inner = inverse(f"(SELECT unnest(range({first}, {last + 1})) AS n)", "n", "n")
    return f"(SELECT n, q + ({center[0]}) AS q, r + ({center[1]}) AS r, {dist('q', 'r', 0, 0)} AS ring FROM ({inner}))"


def score(tokens: list[str]) -> str:
    """The lexical score; tags are in small letters and distinct in these relations."""
    total = "0.1 * confidence"
    for t in tokens:
        total += f" + len(list_filter(tags, lambda x: lower(x) = '{t}')) * 1.0 + len(list_filter(tags, lambda x: starts_with(lower(x), '{t}') AND lower(x) <> '{t}')) * 0.8"
        total += f" + CASE WHEN contains(raw_content, '{t}') THEN 0.6 WHEN contains(lower(raw_content), '{t}') THEN 0.5 ELSE 0 END + CASE WHEN lower(source_id) = '{t}' THEN 0.3 ELSE 0 END"
    return f"CAST({total} AS DOUBLE)"


def matched(tokens: list[str]) -> str:
    return "(" + " OR ".join(f"len(list_filter(tags, lambda x: starts_with(lower(x), '{t}'))) > 0 OR contains(lower(raw_content), '{t}') OR lower(source_id) = '{t}'" for t in tokens) + ")"


def valid(at: int) -> str:
    return f"((valid_from IS NULL OR valid_from <= {at}) AND (valid_to IS NULL OR {at} < valid_to))"


def parent_step(q: str, r: str) -> tuple[str, str, str, str]:
    """Offsets (as CASEs over the residue) and the parent of a coordinate less its offset."""
    residue = f"(((3 * {q} + {r}) % 7 + 7) % 7)"
    oq = "CASE " + residue + " " + " ".join(f"WHEN {i} THEN {a}" for i, (a, _) in enumerate(CHILD_OFFSETS)) + " END"
    orr = "CASE " + residue + " " + " ".join(f"WHEN {i} THEN {b}" for i, (_, b) in enumerate(CHILD_OFFSETS)) + " END"
    return oq, orr, "(3 * cq + cr) // 7", "(2 * cr - cq) // 7"


def parents(source: str, level: int, keep: str) -> str:
    """SELECT of ``keep``, pq and pr: the super-hexagon so many levels up."""
    out = f"(SELECT {keep}, q AS pq, r AS pr FROM {source})"
    for _ in range(level):
        oq, orr, pq, pr = parent_step("pq", "pr")
        out = f"(SELECT {keep}, {pq} AS pq, {pr} AS pr FROM (SELECT {keep}, pq - ({oq}) AS cq, pr - ({orr}) AS cr FROM {out}))"
    return out


def visible(coords: str, blockers: str, center: Coord, radius: int, keep: str) -> str:
    """Rows of ``coords`` that no blocker hides, all within the radius."""
    cq, cr = center
    return f"""WITH_FOV(
      own AS (SELECT DISTINCT q - ({cq}) AS bq, r - ({cr}) AS br FROM {blockers} WHERE {dist('q', 'r', cq, cr)} <= {radius} AND NOT (q = {cq} AND r = {cr})),
      corners AS (SELECT bq, br, 3 * bq + x AS x, 3 * br + y AS y FROM own, (VALUES (2, -1), (1, 1), (-1, 2), (-2, 1), (-1, -1), (1, -2)) t(x, y)),
      lefts AS (SELECT a.bq, a.br, a.x, a.y FROM corners a JOIN corners o USING (bq, br) GROUP BY ALL HAVING min(a.x * o.y - a.y * o.x) >= 0),
      rights AS (SELECT a.bq, a.br, a.x, a.y FROM corners a JOIN corners o USING (bq, br) GROUP BY ALL HAVING min(o.x * a.y - o.y * a.x) >= 0),
      shadows AS (SELECT bq, br, bq * bq + bq * br + br * br AS bd, l.x AS lx, l.y AS ly, g.x AS rx, g.y AS ry FROM lefts l JOIN rights g USING (bq, br)),
      targets AS (SELECT {keep}, q, r, q - ({cq}) AS tq, r - ({cr}) AS tr FROM {coords} WHERE {dist('q', 'r', cq, cr)} <= {radius})
    )SELECT * EXCLUDE (tq, tr) FROM targets t WHERE NOT EXISTS (SELECT 1 FROM shadows s WHERE s.bd < tq * tq + tq * tr + tr * tr AND s.lx * tr - s.ly * tq >= 0 AND tq * s.ry - tr * s.rx >= 0)"""


def fov(body: str, coords: str, blockers: str, center: Coord, radius: int, keep: str, *views: str, more: str = "") -> str:
    head, tail = visible(coords, blockers, center, radius, keep).removeprefix("WITH_FOV(").split("\n    )", 1)
    extra = f"{more}, {head}" if more else head
    return sql(body.replace("VISIBLE", f"({tail})"), *views, more=extra)
