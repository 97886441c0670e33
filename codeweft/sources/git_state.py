"""How far a graph lags behind its working tree. On the driver only.

Git is asked twice: for the status in its machine form, which holds commit, branch and changed files, and for how many
commits each of two ends has that the other lacks. STATES decides by these numbers alone; words are put to them apart."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass

TIMEOUT = 60
#: The first state whose test holds. ours: commits that only the working tree has, theirs: that only the graph has.
STATES = (
    ("diverged", lambda ours, theirs, changed: theirs > 0),
    ("behind", lambda ours, theirs, changed: ours > 0),
    ("dirty", lambda ours, theirs, changed: changed),
    ("fresh", lambda ours, theirs, changed: True),
)
REMEDY = {"fresh": "", "dirty": "files changed since", "behind": "{n} commits behind", "diverged": "its commit is not in the history of HEAD", "no_meta": "no record of its build", "not_git": "no repository at {root}", "git_failed": "git gave no answer"}


@dataclass(frozen=True)
class Answer:
    code: int | None  # None: git is missing or took too long
    lines: list[str]

    @property
    def ok(self) -> bool:
        return self.code == 0


def _ask(root: str, *words: str) -> Answer:
    try:
        done = subprocess.run(["git", "-C", root, *words], capture_output=True, text=True, timeout=TIMEOUT)
    except (OSError, subprocess.TimeoutExpired):
        return Answer(None, [])
    return Answer(done.returncode, done.stdout.splitlines())


def _tree(root: str) -> tuple[Answer, dict | None]:
    status = _ask(root, "status", "--porcelain=v2", "--branch")
    heads = dict(line[2:].split(" ", 1) for line in status.lines if line.startswith("# branch."))
    commit = heads.get("branch.oid", "(initial)")
    if not status.ok or commit == "(initial)":
        return status, None
    branch = heads.get("branch.head", "")
    when = _ask(root, "show", "-s", "--format=%cI", commit).lines
    return status, {
        "commit": commit, "short": commit[:7], "committed_at": when[0] if when else None, "branch": "HEAD" if branch == "(detached)" else branch,
        "dirty": any(not line.startswith("#") for line in status.lines),
    }


def git_info(root: str) -> dict | None:
    """commit, short, committed_at, branch, dirty; None outside a repository or before its first commit."""
    return _tree(root)[1]


def freshness(meta: dict | None, root: str | None = None) -> dict:
    """state: fresh, dirty (same commit, changed files), behind (by how many commits), diverged, or unknown with a reason:
    no_meta, not_git, or git_failed (git is missing, broke off or took too long). Besides graph (meta) and live (the
    working tree)."""
    built = meta or {}
    where = root or built.get("root") or "."
    if not built.get("commit"):
        return {"graph": built, "root": where, "state": "unknown", "reason": "no_meta"}
    status, live = _tree(where)
    known = {"graph": built, "root": where, "live": live}
    if live is None:
        return known | {"state": "unknown", "reason": "git_failed" if status.code is None else "not_git"}
    apart = _ask(where, "rev-list", "--left-right", "--count", f"{built['commit']}...{live['commit']}")
    if apart.ok:
        theirs, ours = map(int, apart.lines[0].split())
        state = next(name for name, holds in STATES if holds(ours, theirs, live["dirty"]))
        return known | {"state": state} | ({} if state == "diverged" else {"behind": ours})
    # a commit that the repository lacks altogether belongs to another history; anything else is git's failure
    absent = apart.code is not None and _ask(where, "cat-file", "-e", f"{built['commit']}^{{commit}}").code not in (0, None)
    return known | ({"state": "diverged"} if absent else {"state": "unknown", "reason": "git_failed"})


def freshness_line(f: dict) -> str:
    state = f.get("reason") or f["state"]
    why = REMEDY[state].format(n=f.get("behind"), root=f.get("root"))
    also = " and files changed" if state == "behind" and f["live"]["dirty"] else ""
    return f"{f['graph'].get('short') or 'graph'} is {f['state']}" + (f" ({why}{also})" if why else "") + ("; load it again" if state in ("dirty", "behind", "diverged", "no_meta") else "")


def freshness_report(name: str, f: dict) -> str:
    """The line, then what is known of the build, a fact a line."""
    facts = {k: f["graph"].get(k) for k in ("nodes", "edges", "model", "branch", "committed_at", "built_at", "dirty_at_build")}
    return "\n".join([f"{name}: {freshness_line(f)}", *(f"  {k.replace('_', ' ')}: {v}" for k, v in facts.items() if v is not None)])
