"""Ignore rules against git's own answers on random trees, and walks by tasks."""

import os
import random
import shutil
import subprocess

import pytest

from lodestone.sources import files as S
from lodestone.sources import ignore as I
from lodestone.sources import walk

pytestmark = pytest.mark.skipif(shutil.which("git") is None, reason="no git")
NAMES = ["a", "b", "build", "x.log", "y.log", "keep.log", "z.py", "Foo", "d d", "#h", "!n", ".env", "a[b]", "日本"]
PATTERNS = [
    "*.log", "!keep.log", "build", "build/", "/build", "/a/", "a/b", "**/b", "b/**", "a/**/x.log", "!a", "!*/", "/*", "!/a", "?", "[ab]", "[!a]", "[^ab]*", "x.[lm]og", "*.p?", "\\#h", "\\!n", "#h", "a\\[b\\]",
    "foo", "Foo/", "d d", "d d  ", "y.log\\ ", "**", "***/b", "*/x.log", "b*/", "[[:alpha:]]", "[a-", "x**g", "/**/z.py", "**/", "日*", "a/", "!b/x.log", "x.log/", "", "   ", "!",
]


def git(at, *args, **k):
    return subprocess.run(["git", "-C", str(at), *args], capture_output=True, check=True, **k).stdout


def grown(r, at, depth=0):
    for name in r.sample(NAMES, r.randrange(2, 6)):
        if depth < 3 and r.random() < 0.45:
            (at / name).mkdir()
            grown(r, at / name, depth + 1)
        else:
            (at / name).write_text("x")
    if depth == 0 or r.random() < 0.4:
        (at / ".gitignore").write_text("\n".join(r.sample(PATTERNS, r.randrange(1, 5))) + r.choice(["", "\n", "\r\n"]))


@pytest.fixture
def home(tmp_path, monkeypatch):
    (tmp_path / "home").mkdir()
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "home"))
    monkeypatch.setenv("GIT_CONFIG_NOSYSTEM", "1")
    return tmp_path


def test_rules_equal_git_on_random_trees(home):
    r = random.Random(8)
    for k in range(60):
        at = home / f"t{k}"
        at.mkdir()
        grown(r, at)
        git(at, "init", "-q")
        if k % 3 == 0:
            (at / ".git/info/exclude").write_text(r.choice(PATTERNS[:20]) + "\n")
        rules = I.Rules(str(at), S._first_rules(at))
        paths = sorted(os.path.relpath(os.path.join(d, x), at) for d, ds, fs in os.walk(at) for x in fs if ".git" not in os.path.relpath(d, at).split(os.sep))
        told = git(at, "ls-files", "-z", "-o", "--exclude-standard").decode().split("\0")
        mine = [p for p in paths if not rules.ignores(p)]
        assert sorted(mine) == sorted(filter(None, told)), {str(f.relative_to(at)): f.read_text() for f in at.rglob(".gitignore")}


def test_discovery_in_a_repository(spark, home):
    at = home / "repo"
    (at / "src/deep").mkdir(parents=True)
    (at / "out").mkdir()
    for name, text in {"src/a.py": "1", "src/deep/b.py": "2", "out/c.bin": "3", "tracked.log": "4", "new.py": "5", ".gitignore": "*.log\nout/\n", "src/.gitignore": "!x.log\n", "src/x.log": "6", "src/deep/y.log": "7"}.items():
        (at / name).write_text(text)
    git(at, "init", "-q")
    git(at, "add", "src/a.py")
    git(at, "add", "-f", "tracked.log")
    os.symlink(at / "new.py", at / "link.py")
    found = lambda *a, **k: {os.path.relpath(x.path, at): x.is_git_tracked for x in S.discover(spark, str(at), *a, **k).collect()}
    assert found() == {"src/a.py": True, "tracked.log": True}
    assert found(untracked=True) == found() | dict.fromkeys(["src/deep/b.py", "new.py", ".gitignore", "src/.gitignore", "src/x.log"], False)
    assert found(untracked=True, respect_gitignore=False) == found(untracked=True) | dict.fromkeys(["out/c.bin", "src/deep/y.log"], False)
    assert "src/x.log" not in found(untracked=True, leave=str(at / "src"))
    rows = spark.createDataFrame([(str(at / n),) for n in ("new.py", "src/deep/y.log", "tracked.log", "out/gone.py")] + [("/elsewhere/x.py",)], "path string")
    assert {os.path.relpath(x.path, at) for x in S.visible(spark, str(at), rows).collect()} == {"new.py", "tracked.log"}


def test_walks_by_tasks(spark, tmp_path):
    r = random.Random(3)
    made = set()
    for _ in range(300):
        d = tmp_path / "t" / "/".join(r.choice("abc") for _ in range(r.randrange(0, 6)))
        d.mkdir(parents=True, exist_ok=True)
        (d / f"f{r.randrange(50)}").write_text("x")
    made = {os.path.join(d, f) for d, _, fs in os.walk(tmp_path / "t") for f in fs}
    for budget in (1, 7, 20_000):
        got = walk.walked(spark, str(tmp_path / "t"), budget=budget).collect() if budget > 1 else walk.walked(spark, str(tmp_path / "t"), budget=40).collect()
        assert sorted(x.path for x in got) == sorted(made) and all(x.size_bytes == 1 and x.error is None for x in got)
    assert not [x for x in walk.walked(spark, str(tmp_path / "t"), leave=str(tmp_path / "t/a")).collect() if "/t/a/" in x.path]
    gone = walk.walked(spark, str(tmp_path / "none")).collect()
    assert [x.error for x in gone] == ["list: No such file or directory"]
    os.mkdir(tmp_path / "odd")
    open(os.path.join(os.fsencode(tmp_path / "odd"), b"\xff.py"), "w").close()
    assert [x.error for x in walk.walked(spark, str(tmp_path / "odd")).collect()] == ["list: the name isn't UTF-8"]
