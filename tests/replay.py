"""What the windows must equal: each file as the list of what happened to it.

A list is judged as a whole. Changes stand at a place of a cycle; thresholds
that have not fired in the cycle are pending, and a change fires the first
pending one that its place has reached. A cycle ends with its last threshold
or at a reset; a file that forgets has all thresholds pending again.
"""

from __future__ import annotations

from collections import Counter, namedtuple

Step = namedtuple("Step", "kind commit author added deleted bug", defaults=(None, None, 0, 0, 0))
Judged = namedtuple("Judged", "metrics refactorings fired base_commit base_metrics place")


def metrics(steps, refactorings):
    changes = [s for s in steps if s.kind == "change"]
    n, per_author = len(changes), Counter(s.author for s in changes)
    minor = sum(20 * k < n for k in per_author.values())
    own = round(max(per_author.values()) / n, 9) if n else 0.0
    return (
        n, sum(s.added for s in changes), sum(s.deleted for s in changes), sum(s.bug for s in changes),
        refactorings, len(per_author), minor, len(per_author) - minor, own,
    )


def judge(steps, cuts):
    """State after the last step, and what that step fired."""
    cuts = sorted(cuts)
    place, pending, refactorings, base = 0, list(cuts), 0, (steps[0].commit, 0, 0)
    fired = at_firing = None
    for i, step in enumerate(steps, 1):
        fired = None
        if step.kind == "reset":
            place, pending, refactorings = 0, list(cuts), refactorings + 1
            base = (step.commit, i, refactorings)
        elif step.kind == "forget":
            pending = list(cuts)
        else:
            place += 1
            if place >= pending[0]:
                fired, at_firing = pending.pop(0), (base, place, refactorings)
            if not pending:
                place, pending, refactorings = 0, list(cuts), refactorings + 1
                base = (step.commit, i, refactorings)
    used, shown, before = at_firing if fired else (base, place, refactorings)
    return Judged(metrics(steps, refactorings), before if fired else refactorings, fired, used[0], metrics(steps[: used[1]], used[2]), shown)


def replay(events, thresholds):
    """events: dicts of one project in order. Returns label snapshots, firings, states after changes, and live files."""
    files, labels, fired, states = {}, [], [], []
    for e in events:
        commit, path = e["commit_id"], e["path"]
        if e["phase"] == 1:
            for _ in range(e["resets"]):
                old = files.get(path, [])
                labels.append((commit, path, judge(old, thresholds).metrics if old else metrics([], 0)))
                files[path] = [*old, Step("reset", commit)]
        elif e["phase"] == 5:
            files.pop(path, None)
        elif e["old_path"] is not None:
            files[path] = [*files.pop(e["old_path"], []), Step("reset" if e["phase"] == 3 else "forget", commit)]
        else:
            files[path] = [*files.get(path, []), Step("change", commit, e["author"], e["added"], e["deleted"], e["is_bug"])]
            now = judge(files[path], thresholds)
            states.append((commit, path, now.metrics[0], now.refactorings))
            if now.fired:
                fired.append((commit, path, now.fired, now.base_commit, now.base_metrics))
    return labels, fired, states, {path: judge(steps, thresholds) for path, steps in files.items()}
