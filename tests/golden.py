"""A sequential model of the run, record by record, to hold the plans against."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict


def draw(seed, user, total):
    return int(hashlib.md5(f"{seed}:{user}:{total}".encode()).hexdigest()[:8], 16) % total


def run(rows, window, exact, item_cut=500, user_cut=500, seed=0, feedback=True):
    """rows: (user, item, ts) in arrival order. Per window: start, deltas, touched, cells, row sums and total."""
    high, late, kept = None, 0, []
    for user, item, ts in rows:
        if high is not None and ts <= high - 1:
            late += 1
        else:
            kept.append((user, item, ts))
        high = ts if high is None else max(high, ts)
    by = defaultdict(list)
    for user, item, ts in kept:
        by[ts - ts % window].append((user, item))
    cells, sums, total = Counter(), Counter(), 0
    exists = set()
    history, totals, counter = defaultdict(list), Counter(), Counter()
    out = []
    for w in sorted(by):
        delta, seen, back = defaultdict(int), set(), Counter()
        base, r = dict(counter), Counter()
        users = defaultdict(list)
        for user, item in by[w]:
            r[item] += 1
            users[user].append((item, exact or base.get(item, 0) + r[item] <= item_cut))
        for item, n in r.items():
            counter[item] = max(base.get(item, 0), min(item_cut, base.get(item, 0) + n))
        for user, items in users.items():
            slots, old, accepted = history[user], list(history[user]), []
            for item, sampled in items:
                totals[user] += 1
                if not sampled:
                    continue
                if exact or len(slots) < user_cut:
                    for o in slots:
                        delta[item, o] += 1
                        delta[o, item] += 1
                    slots.append(item)
                    accepted.append(item)
                    continue
                k = draw(seed, user, totals[user])
                if k >= user_cut:
                    back[item] += 1
                    continue
                for j, o in enumerate(slots):
                    if j != k:
                        delta[slots[k], o] -= 1
                        delta[o, slots[k]] -= 1
                        delta[item, o] += 1
                        delta[o, item] += 1
                slots[k] = item
                accepted.append(item)
            if accepted and not (not old and len(accepted) == 1):
                seen |= set(old) | set(accepted)
        for (i, j), d in delta.items():
            cells[i, j] += d
            sums[i] += d
            total += d
        exists |= set(delta)
        if feedback:
            for item, n in back.items():
                counter[item] -= n
        out.append({"w": w, "deltas": dict(delta), "touched": seen, "cells": {c: cells[c] for c in exists}, "sums": dict(sums), "n": total})
    return out, late


def top(step, k, score):
    """(item, rank, other, k11, score) of a window."""
    out = []
    for item in step["touched"]:
        row = []
        for (i, j), k11 in step["cells"].items():
            if i == item:
                k12, k21 = step["sums"].get(i, 0) - k11, step["sums"].get(j, 0) - k11
                row.append((-round(score(k11, k12, k21, step["n"] + k11 - k12 - k21), 4), j, k11))
        out += [(item, n, j, k11, -s) for n, (s, j, k11) in enumerate(sorted(row)[:k], 1)]
    return sorted(out)
