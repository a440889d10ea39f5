"""The command line end to end."""

from cairnspark import __main__ as command
from cairnspark.__main__ import main
from cairnspark.sources.formats import safe_name

from .test_kernels import splitmix


def test_convert_put_get(spark, tmp_path, capsys, monkeypatch):
    source = tmp_path / "in"
    (source / "deep").mkdir(parents=True)
    contents = {"a.bin": splitmix(300_000, 3), "deep/b.txt": b"text " * 40_000, "deep/copy.bin": splitmix(300_000, 3), "empty": b""}
    for name, data in contents.items():
        (source / name).write_bytes(data)
    assert main(["convert", f"file://{source}", f"{tmp_path}/xorbs", "--codec", "none"], spark) == 0
    stored = list((tmp_path / "xorbs").glob("*.xorb"))
    assert 500_000 < sum(f.stat().st_size for f in stored) < 510_000
    store = f"file://{tmp_path}/store"
    assert main(["put", f"file://{source}", store, "ns/x"], spark) == 0
    assert main(["list", store, "ns/x"], spark) == 0
    assert "deep/copy.bin" in capsys.readouterr().out
    assert main(["get", store, "ns/x", f"{tmp_path}/out"], spark) == 0
    read = lambda out: {str(f.relative_to(out)): f.read_bytes() for f in out.rglob("*") if f.is_file()}
    assert read(tmp_path / "out") == {k: v for k, v in contents.items() if v}
    monkeypatch.setattr(command, "LARGE", 250_000)  # the larger ones go piece by piece
    assert main(["get", store, "ns/x", f"{tmp_path}/pieces"], spark) == 0
    assert read(tmp_path / "pieces") == read(tmp_path / "out")
    assert main(["get", store, "ns/x", f"{tmp_path}/part", "--file", "b.txt", "--range", "3", "9"], spark) == 0
    assert (tmp_path / "part" / "deep" / "b.txt").read_bytes() == contents["deep/b.txt"][3:9]
    assert main(["get", store, "ns/x", f"{tmp_path}/none", "--file", "nope"], spark) == 1


def test_names_stay_apart_and_below():
    names = ["a/b", "a__b", "a%2Fb", "../x", "./x", "x", "/x", "a//b", "..", "%2E%2E", "%"]
    assert len({safe_name(n) for n in names}) == len(names)
    assert not any(part in ("", ".", "..") for n in names for part in safe_name(n).split("/"))
