"""A shell over a store: python -m tidemark.cli [--dir DIR] [--exec COMMAND] [--benchmark]."""

from __future__ import annotations

import argparse
import sys
import time
from concurrent.futures import ThreadPoolExecutor
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.schema import text
from tidemark.plans.stats import human_bytes, percentile, throughput
from tidemark.plans.store import Store
from tidemark.plans.txn import Transaction, TransactionManager

HELP = [
    ("put <key> <value...>", "write a value"),
    ("get <key>", "read a value"),
    ("delete | del | rm <key>", "write a deletion"),
    ("scan [start] [end] [limit]", "keys of [start, end), * for an open side; 50 rows unless said otherwise"),
    ("prefix <prefix> [limit]", "keys that start with a prefix"),
    ("flush", "commit what is buffered"),
    ("compact", "merge all files"),
    ("stats", "counters"),
    ("count", "number of live keys"),
    ("begin", "start a transaction"),
    ("txn-put <key> <value...>", "write within the transaction"),
    ("txn-get <key>", "read within the transaction"),
    ("txn-delete <key>", "delete within the transaction"),
    ("commit", "publish the transaction"),
    ("rollback", "drop the transaction"),
    ("benchmark [writes] [reads] [threads]", "write and read many keys"),
    ("help | ?", "this table"),
    ("exit | quit", "leave"),
]
WIDEST = 60


def tokens(line: str | None) -> list[str]:
    """Words of a command line. Quotes of either kind join what they enclose to what they touch; one left open ends with the line."""
    out, word, quote = [], "", ""
    for c in line or "":
        if quote:
            if c == quote:
                quote = ""
            else:
                word += c
        elif c in "\"'":
            quote = c
        elif c.isspace():
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return [*out, word] if word else out


def table(head: list[str], rows: list[list], widest: int = WIDEST) -> str:
    """Rows as an ASCII table; cells beyond widest (10 at least) are cut to end in dots, null cells are empty."""
    widest = max(widest, 10)

    def cell(v) -> str:
        s = "" if v is None else str(v)
        return s if len(s) <= widest else s[: widest - 3] + "..."

    cells = [list(map(cell, r)) for r in (head, *rows)]
    width = [max(len(r[k]) for r in cells) for k in range(len(head))]
    rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    body = ["| " + " | ".join(c.ljust(w) for c, w in zip(r, width, strict=True)) + " |" for r in cells]
    return "\n".join([rule, body[0], rule, *body[1:], rule])


class Shell:
    """Executes command lines. Errors are printed, and the shell goes on."""

    def __init__(self, store: Store, out: TextIO = sys.stdout):
        self.store, self.out = store, out
        self.manager, self.txn = TransactionManager(store), None

    def say(self, line: str) -> None:
        print(line, file=self.out)

    def execute(self, line: str) -> bool:
        """Run one line; False if it ends the shell."""
        words = tokens(line)
        if not words:
            return True
        name, args = words[0].lower(), words[1:]
        if name in ("exit", "quit"):
            if self.txn and self.txn.active:
                self.txn.rollback()
                self.say("open transaction rolled back")
            return False
        name = {"del": "delete", "rm": "delete", "?": "help"}.get(name, name).replace("-", "_")
        run = getattr(self, f"do_{name}", None)
        try:
            if run is None:
                self.say(f"unknown command '{words[0]}'; try help")
            else:
                run(args)
        except Exception as e:
            self.say(f"[ERROR] {e}")
        return True

    def _usage(self, args: list[str], least: int, line: str) -> bool:
        if len(args) < least:
            self.say(f"usage: {line}")
        return len(args) >= least

    def _timed(self, what: str, run) -> None:
        began = time.perf_counter_ns()
        found = run()
        self.say(f"{what if found is None else found} ({(time.perf_counter_ns() - began) // 1000} us)")

    def _open(self) -> Transaction | None:
        if self.txn is None or not self.txn.active:
            self.say("no open transaction; use begin")
            return None
        return self.txn

    def _rows(self, found: DataFrame, limit: int) -> None:
        rows = found.select("key", text().alias("value"), "ts_ms").orderBy("key").limit(limit).collect() if limit > 0 else []
        self.say(table(["Key", "Value", "Timestamp"], [list(r) for r in rows]))
        self.say(f"{len(rows)} rows")

    def do_put(self, a: list[str]) -> None:
        if self._usage(a, 2, "put <key> <value...>"):
            self._timed("OK", lambda: self.store.put(a[0], " ".join(a[1:])))

    def do_get(self, a: list[str]) -> None:
        if self._usage(a, 1, "get <key>"):
            self._timed("", lambda: "(nil)" if (v := self.store.get_text(a[0])) is None else f'"{v}"')

    def do_delete(self, a: list[str]) -> None:
        if self._usage(a, 1, "delete <key>"):
            self._timed("OK", lambda: self.store.delete(a[0]))

    def do_scan(self, a: list[str]) -> None:
        start, end = (None if len(a) <= k or a[k] == "*" else a[k] for k in (0, 1))
        self._rows(self.store.scan(start, end, ordered=False), int(a[2]) if len(a) > 2 else 50)

    def do_prefix(self, a: list[str]) -> None:
        if self._usage(a, 1, "prefix <prefix> [limit]"):
            limit = int(a[1]) if len(a) > 1 else 50
            if limit < 0:
                raise ValueError("limit can't be negative")
            self._rows(self.store.prefix(a[0], ordered=False), limit)

    def do_flush(self, a: list[str]) -> None:
        self._timed("flushed", lambda: self.store.flush() and None)

    def do_compact(self, a: list[str]) -> None:
        self._timed("compacted", lambda: self.store.compact() and None)

    def do_stats(self, a: list[str]) -> None:
        s = self.store.stats
        rows = [[k, f"{v:,}"] for k, v in s.as_dict().items()]
        self.say(table(["Metric", "Value"], [*rows, ["memtable_hit_ratio", f"{s.memtable_hit_ratio:.2%}"], ["disk", human_bytes(s.disk_bytes)]]))

    def do_count(self, a: list[str]) -> None:
        self.say(f"{self.store.query().count_live().first()['n']} live keys")

    def do_begin(self, a: list[str]) -> None:
        if self.txn and self.txn.active:
            self.say(f"transaction {self.txn.id} is open already")
        else:
            self.txn = self.manager.begin()
            self.say(f"transaction {self.txn.id} on version {self.txn.start}")

    def do_txn_put(self, a: list[str]) -> None:
        if self._usage(a, 2, "txn-put <key> <value...>") and (t := self._open()):
            t.put(a[0], " ".join(a[1:]))
            self.say("OK")

    def do_txn_get(self, a: list[str]) -> None:
        if self._usage(a, 1, "txn-get <key>") and (t := self._open()):
            v = t.get_text(a[0])
            self.say("(nil)" if v is None else f'"{v}"')

    def do_txn_delete(self, a: list[str]) -> None:
        if self._usage(a, 1, "txn-delete <key>") and (t := self._open()):
            t.delete(a[0])
            self.say("OK")

    def do_commit(self, a: list[str]) -> None:
        if t := self._open():
            t.commit()
            self.txn = None
            self.say("committed")

    def do_rollback(self, a: list[str]) -> None:
        if t := self._open():
            t.rollback()
            self.txn = None
            self.say("rolled back")

    def do_benchmark(self, a: list[str]) -> None:
        writes, reads, threads = (int(a[k]) if len(a) > k else n for k, n in enumerate((10_000, 10_000, 4)))
        for name, r in benchmark(self.store, writes, reads, threads).items():
            self.say(table([name, ""], [[k, v] for k, v in r.items()]))

    def do_help(self, a: list[str]) -> None:
        self.say(table(["Command", "Does"], [list(h) for h in HELP], 100))


def benchmark(store: Store, writes: int = 10_000, reads: int = 10_000, threads: int = 4) -> dict[str, dict]:
    """Single puts and gets, four of five gets of keys that are there, by several threads, and the time that each took."""
    if min(writes, reads, threads) <= 0:
        raise ValueError("writes, reads and threads must be positive")

    def timed(n: int, run) -> dict:
        took: list[int] = []  # microseconds; appending is atomic

        def work(part: range) -> None:
            for k in part:
                began = time.perf_counter_ns()
                run(k)
                took.append((time.perf_counter_ns() - began) // 1000)

        began = time.perf_counter_ns()
        with ThreadPoolExecutor(threads) as pool:
            for done in [pool.submit(work, range(k, n, threads)) for k in range(threads)]:
                done.result()
        elapsed = (time.perf_counter_ns() - began) / 1e6
        return {"operations": n, "elapsed_ms": round(elapsed, 3), "ops_per_second": f"{throughput(n, elapsed):,.2f}", "avg_us": sum(took) / len(took)} | {f"p{p}_us": percentile(took, p / 100) for p in (50, 95, 99)}

    put = timed(writes, lambda k: store.put(f"user:{k:08d}", "payload of fixed length for all keys"))
    return {"PUT": put, "GET": timed(reads, lambda k: store.get(f"user:{k % writes:08d}" if k % 5 < 4 else f"none:{k:08d}"))}


def bulk_benchmark(store: Store, writes: int = 10_000, reads: int = 10_000, repeats: int = 5) -> dict[str, dict]:
    """One append of many keys, and lookups of many keys, four of five present, as one join; latencies over repeats."""
    spark = store.spark
    out = {}
    keys = spark.range(writes).select(F.format_string("user:%08d", F.col("id")).alias("key"), F.lit("payload of fixed length for all keys").cast("binary").alias("value"))
    asked = spark.range(reads).select(F.when(F.col("id") % 5 < 4, F.format_string("user:%08d", F.col("id") % max(writes, 1))).otherwise(F.format_string("none:%08d", F.col("id"))).alias("key"))
    for name, n, run in (("PUT", writes, lambda: store.append(keys)), ("GET", reads, lambda: store.multi_get(asked).write.format("noop").mode("overwrite").save())):
        times = []
        for _ in range(repeats):
            began = time.perf_counter_ns()
            run()
            times.append((time.perf_counter_ns() - began) / 1e6)
        mean = sum(times) / len(times)
        out[name] = {"operations": n, "batches": repeats, "mean_ms": round(mean, 3), "least_ms": round(min(times), 3), "ops_per_second": f"{throughput(n, mean):,.2f}"}
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--dir", "-d", default="./data/tidemark")
    p.add_argument("--exec", "-e", action="append", dest="commands")
    p.add_argument("--benchmark", "-b", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    with Store(spark, a.dir, background=True) as store:
        shell = Shell(store)
        if a.benchmark:
            shell.execute("benchmark")
        elif a.commands:
            for line in a.commands:
                shell.execute(line)
        else:
            while True:
                try:
                    line = input("tidemark> ")
                except EOFError:
                    break
                if not shell.execute(line):
                    break
    return 0


if __name__ == "__main__":
    sys.exit(main())
