"""The listing of files against a plain walk."""

import os
from pathlib import Path

from lexhaul.sources import listing
from lexhaul.sources.files import SUPPORTED


def naive(entries):
    """Sorted files of folders with a supported suffix, named paths as they are, each resolved file once."""
    found, seen = [], set()
    for e in map(Path, entries):
        for p in [p for p in sorted(e.rglob("*")) if p.is_file() and p.suffix.lower() in SUPPORTED] if e.is_dir() else [e]:
            key = p.resolve() if p.exists() else p
            if key not in seen:
                seen.add(key)
                found.append(str(p))
    return found


def test_files_equal_a_plain_walk(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for at in ("a/_x/.deep", "a/sub", "a/sub-more", "a/.hidden", "b"):
        (tmp_path / at).mkdir(parents=True)
    for name in ("a/z.md", "a/_first.txt", "a/.dot.md", "a/_x/.deep/Q.PDF", "a/sub/one.TXT", "a/sub/two.exe", "a/sub-more/three.md", "a/sub.md", "a/.hidden/h.docx", "a/none", "b/x.md", "b/y.bin"):
        (tmp_path / name).write_text(name)
    os.symlink(a / "z.md", b / "again.md")
    os.symlink(a / "sub", b / "linked")
    (a / "folder.md").mkdir()
    (a / "empty.md").write_text("")
    for entries in ([a, b], [b, a], [b / "y.bin", a, a / "z.md", tmp_path / "gone.md", b / "y.bin"], [a / "sub", a], [tmp_path]):
        got = listing.collect_files(spark, list(map(str, entries))).orderBy("position").collect()
        assert [r.path for r in got] == naive(entries)
        assert [r.position for r in got] == list(range(len(got)))
        for r in got:
            assert (bytes(r.content).decode() if r.content is not None else None) == (Path(r.path).read_text() if Path(r.path).exists() else None)
    assert listing.collect_files(spark, [str(a / "folder.md")]).count() == 0 == listing.collect_files(spark, []).count()
    folders = spark.read.format("listing").option("entries", str(a)).load()
    assert folders.rdd.getNumPartitions() == 7  # one for each folder
