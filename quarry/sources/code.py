"""A small corpus of code, written for tests and for the queries on structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = {
    "app/store.py": '''# storage helpers
import os
import json
from pathlib import Path

LIMIT = 10
ROOT = Path("/srv")


class Store:
    """Keeps rows."""

    def __init__(self, path):
        self.path = path
        self.rows = []

    def load(self):
        if os.path.exists(self.path):
            for row in read_rows(self.path):
                self.rows.append(row)
        return self.rows


@cached
def read_rows(path):
    with open(path) as handle:
        return json.load(handle)


def check_password(user, word):
    if not user:
        return False
    for item in read_rows(ROOT):
        if item == word:
            return True
    return verify(word)


def verify(word):
    return len(word) > LIMIT

DEFAULT = 1
''',
    "app/tasks.py": '''import queue
from threading import Thread


async def pump(source):
    while True:
        item = await source.get()
        handle(item)


def handle(item):
    try:
        work(item)
    except ValueError:
        log(item)


def work(item):
    return item


if __name__ == "__main__":
    handle(1)
    handle(2)
    handle(3)
''',
    "web/main.js": '''const limit = 3;
let total = 0;
function add(x) {
  total = total + x;
}
module.exports = add;
''',
    "srv/main.go": '''package main
import (
  "fmt"
)
func main() {
  fmt.Println(1)
}
''',
    "notes.txt": "nothing here\nbut words\n",
    "broken.py": "def broken(:\n    pass\n",
}


def corpus(spark: SparkSession) -> DataFrame:
    """file_path, content."""
    return spark.createDataFrame(list(FILES.items()), "file_path string, content string")


def values_sql() -> str:
    """The same rows as a SQL relation ``code``."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return "code(file_path, content) AS (VALUES " + ", ".join(f"({quote(k)}, {quote(v)})" for k, v in FILES.items()) + ")"
