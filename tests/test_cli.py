from __future__ import annotations

from veclattice import cli


def test_life(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv(cli.FOLDER, str(tmp_path))
    (tmp_path / "f.txt").write_text("green grass grows")
    assert cli.main(["demo", "--docs", "red stone", " ", "blue water", "--files", str(tmp_path / "f.txt"), "--query", "blue water", "--index-name", "i", "--nbits", "4"]) == 0
    out = capsys.readouterr().out
    assert "3 documents" in out and "1. [1]" in out
    assert cli.main(["update", "--index-name", "i", "--docs", "white snow", "--files", "/none"]) == 0
    assert "added 3 to 3" in capsys.readouterr().out
    (tmp_path / "ids").write_text("0\nx\n")
    assert cli.main(["delete", "--index-name", "i", "--doc-ids", "9", "--ids-file", str(tmp_path / "ids")]) == 0
    assert "deleted 0" in capsys.readouterr().out
    assert cli.main(["demo", "--existing", "--index-name", "i", "--query", "white snow", "--top-k", "1"]) == 0
    assert "1. [2]" in capsys.readouterr().out
    assert cli.main(["demo", "--existing", "--index-name", "none"]) == 1
    assert cli.main(["demo", "--docs", " "]) == 1


def test_small(spark, capsys):
    assert cli.main(["remap-test"]) == 0
    assert cli.main(["similarity", "two three", "one two three"]) == 0
    assert "2.0000" in capsys.readouterr().out
    assert cli.main(["tokenize", "two three"]) == 0
    assert "tokens: two three" in capsys.readouterr().out
