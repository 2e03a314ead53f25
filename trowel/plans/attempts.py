"""Competing attempts at one job: modules grouped, greedily and in order, by the specific names that they share.

A group is described in one task, so its modules are assumed to fit one; grouping itself is relational.
"""

from __future__ import annotations

import re

import pyarrow as pa

MIN_SHARED = 3
#: Definition names that any module may have.
GENERIC = ["main", "run", "start", "stop", "setup", "teardown", "init", "__init__", "get", "set", "load", "save", "read", "write", "open", "close", "parse", "format", "handle", "process", "execute", "call", "send", "receive", "create", "update", "delete", "list", "find", "search", "build", "make", "to_dict", "as_dict", "from_dict", "serialize", "deserialize", "validate", "check", "test", "helper", "wrapper", "factory", "__repr__", "__str__", "__enter__", "__exit__", "configure", "connect", "disconnect", "reset"]
#: Words of folder names for what is kept aside.
ASIDE = ["backup", "backups", "bak", "archive", "archived", "archives", "old", "orig", "original", "copy", "copies", "previous", "prev", "deprecated", "legacy", "obsolete", "attic", "saved", "snapshot", "snapshots"]

SCHEMA = (
    "verdict string, resume_at string, resume_percent int, resume_lines int, elsewhere_percent int, at_stake_lines int, remaining_lines int, unwritten int, copy_of string, shared array<string>, common_gaps array<string>, "
    "members array<struct<key: string, rank: int, percent: int, lines: int, tests: int, facts: array<string>>>, lineage array<struct<key: string, added: array<string>, dropped: array<string>, carried: array<string>>>"
)


def _aside(relpath: str) -> bool:
    words = re.findall("[a-z0-9]+", relpath.rpartition("/")[0].lower())
    return any(w in ASIDE for w in words)


def _copied_aside(a: dict, b: dict) -> bool:
    """Same file name in another folder, one of the two kept aside."""
    (da, _, na), (db, _, nb) = a["relpath"].rpartition("/"), b["relpath"].rpartition("/")
    return na.lower() == nb.lower() and da != db and (_aside(a["relpath"]) or _aside(b["relpath"]))


def completeness(row: dict) -> float:
    tops = len(row["filled"]) + len(row["empty"])
    body = 0.7 * len(row["filled"]) / tops if tops else 0.0
    score = body + 0.2 * row["reachable"] + 0.1 * (row["tests"] > 0)
    return round(min(max(body, score - min(0.03 * row["todos"], 0.12)) if row["todos"] else score, 1.0), 3)


def what_is_known(row: dict) -> list[str]:
    """How a module's completeness comes about, in words."""
    tests, todos, empty = row["tests"], row["todos"], sorted(row["empty"])
    return [
        f"{len(row['filled'])} of {len(row['filled']) + len(empty)} definitions are written",
        *([f"empty: {', '.join(empty)}"] if empty else []),
        "an entry point leads to it" if row["reachable"] else "nothing leads to it",
        f"named in {tests} test{'' if tests == 1 else 's'}" if tests else "no test names it",
        *([f"{todos} open marker{'' if todos == 1 else 's'}"] if todos else []),
    ]


def _same_sets(members: list[dict]) -> list[list[dict]]:
    """Transitive sets of members with equal names or kept aside, in order of their first member."""
    top = list(range(len(members)))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    def unite(i: int, j: int) -> None:
        i, j = find(i), find(j)
        top[max(i, j)] = min(i, j)

    by_names: dict[frozenset, int] = {}
    by_file: dict[str, list[int]] = {}
    for i, m in enumerate(members):
        unite(i, by_names.setdefault(frozenset(m["names"]), i))
        by_file.setdefault(m["relpath"].rpartition("/")[2].lower(), []).append(i)
    for same in by_file.values():
        for i in same:
            for j in same if _aside(members[i]["relpath"]) else ():
                if _copied_aside(members[i], members[j]):
                    unite(i, j)
    sets: dict[int, list[dict]] = {}
    for i, m in enumerate(members):
        sets.setdefault(find(i), []).append(m)
    return list(sets.values())


def _ranked(members: list[dict]) -> list[dict]:
    return sorted(members, key=lambda m: (-m["score"], -m["loc"], m["key"]))


def _lineage(members: list[dict]) -> list[dict]:
    known: set[str] = set()
    out = []
    for m in sorted(members, key=lambda m: (len(m["names"]), m["score"], m["key"])):
        out.append({"key": m["key"], "added": sorted(m["names"] - known), "dropped": sorted(known - m["names"]), "carried": sorted(m["names"] & known)})
        known |= m["names"]
    return out


def _described(members: list[dict]) -> dict:
    members = _ranked(members)
    leader, others = members[0], members[1:]
    copy = next((m for m in others if m["names"] == leader["names"]), None) or next((m for m in others if _copied_aside(m, leader)), None)
    elsewhere = set().union(*(m["names"] for m in others)) & leader["names"]
    share = len(elsewhere) / len(leader["names"]) if leader["names"] else 0.0
    percent = round(100 * leader["score"])
    tops = len(leader["filled"]) + len(leader["empty"])
    counts: dict[str, int] = {}
    for m in members:
        for n in m["names"]:
            counts[n] = counts.get(n, 0) + 1
    return {
        "verdict": "copy" if copy else "restart",
        "resume_at": leader["key"],
        "resume_percent": percent,
        "resume_lines": leader["loc"],
        "elsewhere_percent": round(100 * share),
        "at_stake_lines": round(leader["loc"] * (percent / 100) * (1 - share)),
        "remaining_lines": round(leader["loc"] * len(leader["empty"]) / tops) if tops else 0,
        "unwritten": len(leader["empty"]),
        "copy_of": copy["relpath"] if copy else None,
        "shared": sorted(n for n, c in counts.items() if c > 1),
        "common_gaps": sorted(set.intersection(*(set(m["empty"]) for m in members))),
        "members": [{"key": m["key"], "rank": i + 1, "percent": round(100 * m["score"]), "lines": m["loc"], "tests": m["tests"], "facts": what_is_known(m)} for i, m in enumerate(members)],
        "lineage": _lineage(members),
    }


def describer(schema: pa.Schema):
    """A function for applyInArrow: one group's restarts over live representatives, and each set of copies."""

    def describe(table: pa.Table) -> pa.Table:
        members = _ranked([r | {"names": set(r["defines"]), "score": completeness(r)} for r in table.to_pylist()])
        sets = _same_sets(members)
        if len(sets) == 1:
            return pa.Table.from_pylist([_described(members)], schema)
        live = _described([next((m for m in s if not _aside(m["relpath"])), s[0]) for s in sets])
        return pa.Table.from_pylist([live, *(_described(s) for s in sets if len(s) > 1)], schema)

    return describe
