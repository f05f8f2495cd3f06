"""Files that grow, are renamed and begin anew: no line lost or read twice, over restarts."""

from __future__ import annotations

import io
import random

import pytest

from huntframe.streaming import detect, follow


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(follow.Follow)
    return spark


class Opened(io.BytesIO):
    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


def test_ranges_split_lines_between_them(monkeypatch):
    rnd = random.Random(1)
    monkeypatch.setattr(follow, "STEP", 7)
    for _ in range(50):
        text = "".join(rnd.choice(["", "a", "bc" * rnd.randint(0, 9), "é"]) + rnd.choice(["\n", "\n", "\r\n"]) for _ in range(rnd.randint(1, 20)))
        data, size = text.encode(), rnd.randint(1, 30)
        got = [line for a in range(0, len(data), size) for line in follow.lines(Opened(data), a, min(a + size, len(data)))]
        want = [x.removesuffix("\r") for x in text.split("\n")[:-1]]
        assert [x for _, x in got] == want and all(data[a:].decode().startswith(x) for a, x in got)
        assert follow._last_end(Opened(data + b"half"), len(data) + 4) == len(data)


def test_growing_and_rotated_files(source, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    sent, n = [], 0

    def write(name, count, half=""):
        nonlocal n
        with open(logs / name, "a") as f:
            for _ in range(count):
                f.write(f"line {n}\n")
                sent.append(f"line {n}")
                n += 1
            f.write(half)

    def run():
        stream = source.readStream.format("follow").option("path", str(logs)).option("contains", ".log").option("rangeBytes", 50).load()
        detect.run_to_end(stream, f"{tmp_path}/state", f"{tmp_path}/out")
        return sorted(r.value for r in source.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect())

    write("a.log", 20)
    write("ignored.txt", 1)
    sent.pop()
    assert run() == sorted(sent)
    write("a.log", 5, half="li")  # a line that is still being written
    assert run() == sorted(sent)
    with open(logs / "a.log", "a") as f:
        f.write("ne half\n")
    sent.append("line half")
    (logs / "a.log").rename(logs / "a.log.1")  # rotated between two runs, with lines that weren't read yet
    write("a.log", 7)
    write("b.log", 1)
    assert run() == sorted(sent)
    assert run() == sorted(sent)
    write("a.log.1", 2)
    write("b.log", 30)
    assert run() == sorted(sent)
