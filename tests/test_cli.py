"""Commands in this process: output and exit codes."""

from __future__ import annotations

import pytest

from tabloom.cli import COMMANDS, main


@pytest.fixture
def people(tmp_path, spark):
    path = tmp_path / "people.csv"
    path.write_text('id,name,amount\n1,Ann,"1.234,50"\n2,Bo,x\n2,Bo,7\n')
    return str(path)


def run(capsys, *argv):
    code = main(list(argv))
    return code, capsys.readouterr().out


def test_tables(people, capsys, tmp_path):
    assert run(capsys, "cut", people, "-c", "name,id", "-r", "id=key") == (0, "name,key\nAnn,1\nBo,2\nBo,2\n")
    assert run(capsys, "filter", people, "-w", "id = 2", "--count") == (0, "2\n")
    assert run(capsys, "sort", people, "-k", "id:desc") == (0, 'id,name,amount\n2,Bo,x\n2,Bo,7\n1,Ann,"1.234,50"\n')
    assert run(capsys, "group", people, "-k", "name") == (0, "name,count\nAnn,1\nBo,2\n")
    assert run(capsys, "unique", people, "-k", "id", "--keep", "last") == (0, 'id,name,amount\n1,Ann,"1.234,50"\n2,Bo,7\n')
    assert run(capsys, "numbers", people, "-c", "amount") == (0, "id,name,amount\n1,Ann,1234.50\n2,Bo,x\n2,Bo,7\n")
    assert run(capsys, "numbers", people, "-c", "amount", "--strict")[0] == 1
    assert run(capsys, "check", people, "-r", "id:unique")[:1] == (1,)
    assert run(capsys, "transpose", people)[1].startswith("id,1,2,2\nname,Ann,Bo,Bo\n")
    assert run(capsys, "to-json", people, "--lines")[1].startswith('{"id": 1, "name": "Ann", "amount": "1.234,50"}\n')
    assert run(capsys, "look", people, "-c", "id", "-n", "1") == (0, "id\n--\n 1\n")
    out = str(tmp_path / "out.csv")
    assert run(capsys, "clean", people, "-o", out)[0] == 0 and run(capsys, "clean", people, "-o", out)[0] == 2
    assert run(capsys, "diff", people, people, "-k", "id")[0] == 2
    assert run(capsys, "cut", people, "-c", "nope")[0] == 2 and run(capsys, "cut", people + "x", "-c", "id")[0] == 1


def test_diff_gives_all_rows(capsys, tmp_path, spark):
    """More than a thousand changed rows, and the totals."""
    old, new = tmp_path / "old.csv", tmp_path / "new.csv"
    old.write_text("id,v\n0,same\ngone,x\n" + "".join(f"{i},a\n" for i in range(1, 1202)))
    new.write_text("id,v\n0,same\nmore,x\n" + "".join(f"{i},b\n" for i in range(1, 1202)))
    code, out = run(capsys, "diff", str(old), str(new), "-k", "id")
    lines = out.splitlines()
    assert code == 1 and sorted(x for x in lines if x.startswith("~ ")) == sorted(f"~ {i}" for i in range(1, 1202))
    assert "+ more" in lines and "- gone" in lines and lines[-1] == "added 1, removed 1, changed 1201, unchanged 1"
    assert run(capsys, "diff", str(old), str(old), "-k", "id") == (0, "no differences\nadded 0, removed 0, changed 0, unchanged 1203\n")


def test_json_lines(capsys, tmp_path, spark):
    """Lines in order and by their numbers, though tasks get a part of the file each."""
    path = tmp_path / "x.jsonl"
    path.write_text("".join(f'{{"k": {i}}}\n\n' for i in range(2000)) + '{"k": NaN}\n[1 ]')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert main(["json", str(path), "--lines"]) == 1
        out, err = capsys.readouterr()
        assert out == "".join(f'{{"k":{i}}}\n' for i in range(2000)) + "[1]\n" and err == f"{path}:4001: NaN is not valid JSON\n"
        path.write_text("".join(f'{{"k": {i}}}\n\n' for i in range(2000)))
        assert run(capsys, "from-json", str(path)) == (0, "k\n" + "".join(f"{i}\n" for i in range(2000)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_commands_are_declared(spark):
    assert len(COMMANDS) == 37
    with pytest.raises(SystemExit):
        main(["nonsense"])
