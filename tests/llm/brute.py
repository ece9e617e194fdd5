"""Plain restatements of the operators' rules, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components(rows, k, percent=80):
    """component of each (key, text); rows of one key are one document."""
    sets = [(key, shingles(t, k)) for key, t in rows if key is not None]
    parent = {key: key for key, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[i + 1 :]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {key: root(key) for key in parent}


def repeats(rows, n=20):
    """(key, words, removed, sha256) per row; identical rows are one document."""
    order = {r: i for i, r in enumerate(sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)))}
    seen, gone = set(), defaultdict(set)
    for row in order:
        w = words(row[1])
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            if key in seen:
                gone[row] |= set(range(i, i + n))
            seen.add(key)
    out = []
    for row in rows:
        w = words(row[1])
        kept = [x for i, x in enumerate(w) if i not in gone[row]]
        out.append((row[0], len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def measures(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered),
        len(lines), len(re.findall("[A-Z]", t)), len(re.findall("[A-Za-z]", t)), t.count("|"), t.count("!"),
    )


# Conversations --------------------------------------------------------------------


def _space(v):
    return " " if v is None else str(v)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{_space(conv)}:{_space(turn)}".encode()) % 20
        role, text = _space(role), _space(text)
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def row_faults(rows):
    """b, d, t or nothing for each (role, text) in order."""
    seen, out = set(), []
    for row in rows:
        solid = re.sub(r"[\x20\x09-\x0D]+", "", row[1])
        out.append("b" if not solid else "d" if row in seen else "t" if solid[-1] not in ".!?" else "")
        seen.add(row)
    return out


def all_repairs(rows):
    """(cost, audit, lines) of every repair of a short conversation with at most two inserts in a row."""
    faults = row_faults(rows)
    found = []

    def go(at, inserted, cost, audit, lines):
        if inserted < 2:
            for role in ("user", "assistant"):
                go(at, inserted + 1, cost + 2, audit + "I", [*lines, (role, "")])
        if at == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)):
                found.append((cost, audit, [f"{r}:{t}" for r, t in lines]))
            return
        role, text = rows[at]
        go(at + 1, 0, cost + 3, audit + "D", lines)
        if faults[at] not in ("b", "d"):
            more = faults[at] == "t"
            go(at + 1, 0, cost + more, audit + "K", [*lines, (role, text)])
            for other in ("user", "assistant"):
                go(at + 1, 0, cost + 2 + more, audit + "R", [*lines, (other, text)])

    go(0, 0, 0, "", [])
    return found


def repair(rows):
    """(cost, audit, lines) by minimum over the last accepted initial, row by row."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    def put(states, state, value):
        if state is not None and (state not in states or value[:2] < states[state][:2]):
            states[state] = value
            return True
        return False

    def inserts(states):
        while any(
            put(states, after.get((s, x)), (c + 2, a + "I", [*o, f"{names[x]}:"])) for s, (c, a, o) in list(states.items()) for x in "ua"
        ):
            pass
        return states

    states = inserts({"": (0, "", [])})
    for (role, text), fault in zip(rows, row_faults(rows)):
        new = {}
        for s, (c, a, o) in states.items():
            put(new, s, (c + 3, a + "D", o))
            if fault not in ("b", "d"):
                c += fault == "t"
                put(new, after.get((s, role[:1])), (c, a + "K", [*o, f"{role}:{text}"]))
                for x in "ua":
                    put(new, after.get((s, x)), (c + 2, a + "R", [*o, f"{names[x]}:{text}"]))
        states = inserts(new)
    return min(states[s] for s in ("", "a") if s in states)


def conversations(rows):
    """The contract's row for every conversation of ``rows`` (conv, turn, role, text), damaged first."""
    groups = {r[0]: [] for r in rows}
    for r in damaged(rows):
        groups[r[0]].append(r)
    out = []
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        said = [r[2:] for r in own]
        cost, audit, lines = repair(said)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, initials = row_faults(said), [r[0][:1] for r in said]
        wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in "bdt"), wrong, cost, audit, digest))
    return out


# Spelling -------------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short = min(len(a), len(b))
    head = next((i for i in range(short) if a[i] != b[i]), short)
    tail = next((i for i in range(short) if a[-1 - i] != b[-1 - i]), short)
    return head + tail >= max(len(a), len(b)) - 1


def variants(rows, slip=199):
    """(word, form, root, n, n_near, form_n) of the words of (key, text)."""
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % slip == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    form, near = {}, {w: [v for v in n if one_edit(w, v)] for w in n}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return [(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n]


def targets(sizes: dict, weights: dict, total: int, most: float = 3) -> dict:
    """Words per source: shares of ``total`` by weight, none above ``most`` times its size."""
    out, free = {}, set(sizes)
    left = float(total)
    while free:
        weight = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / weight > most * sizes[s]} if weight else free
        if not over:
            return out | {s: left * weights[s] / weight for s in free}
        out |= {s: float(most * sizes[s]) for s in over}
        left -= sum(out[s] for s in over)
        free -= over
    return out


def cycle_weights(sources, cycle: tuple[float, ...] = (5, 2, 1)) -> dict:
    """Weights by code point order of the source, null last."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: cycle[i % len(cycle)] for i, s in enumerate(ordered)}
