"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A change row states what a document (or several alike) counted before and counts after it: an insert has nothing
before, a delete nothing after, a revised count both. A batch of changes is summed to one signed delta per group,
written to a folder of its own and committed by a marker file under its batch id, whose name one writer alone can claim
(the file's content names the folder): a batch that is sent again, whole or after a lost driver, or by two drivers at
once, changes nothing. Totals are sums over the committed deltas and never reread documents; merge() puts the deltas of
all batches so far into one folder, again behind one claimed marker, so that totals read a bounded number of them.

Defined results: null source, language or version is a group of its own; null counts are 0; groups whose documents
and tokens both come to 0 are left out of the totals; an empty batch commits an empty delta; repeated change rows
count each time they occur (within one batch), as they are separate documents.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.sources.files import Files

GROUP = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, d_docs long, d_tokens long"
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text):
    """Words between white space; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def change(df: DataFrame, tokenizer: str, before, after) -> DataFrame:
    """Change rows from columns: before and after are (documents, tokens) pairs of columns or numbers."""
    as_long = lambda x: F.coalesce((x if not isinstance(x, int) else F.lit(x)).cast("long"), F.lit(0))
    return df.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), (as_long(after[0]) - as_long(before[0])).alias("d_docs"), (as_long(after[1]) - as_long(before[1])).alias("d_tokens"))


class TokenRollup:
    """The committed deltas in one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._files = spark, root.rstrip("/"), Files(spark, root)
        for folder in ("deltas", "commits", "merges"):
            self._files.make(folder)

    def committed(self, batch_id: str) -> bool:
        return self._files.exists(f"commits/{quote(batch_id, safe='')}")

    def _staged(self, sums: DataFrame) -> str:
        folder = f"deltas/{uuid.uuid4().hex}"
        sums.groupBy(*GROUP).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")).write.parquet(self._files.full(folder))
        return folder

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds the batch's deltas; False, with nothing changed, if this batch id is committed already."""
        if self.committed(batch_id):
            return False
        folder = self._staged(changes)
        if self._files.write_new(f"commits/{quote(batch_id, safe='')}", folder.encode()):
            return True
        self._files.delete(folder)
        return False

    def batches(self) -> list[str]:
        return sorted(x for x in self._files.names("commits") if not x.endswith(".tmp"))

    def _merged(self) -> dict:
        """The newest merge: the number of it, its folder and the batches it holds."""
        last = max((int(x) for x in self._files.names("merges") if x.isdigit()), default=0)
        return json.loads(self._files.read(f"merges/{last}")) | {"number": last} if last else {"number": 0, "folder": None, "batches": []}

    def _folders(self, merged: dict) -> list[str]:
        rest = sorted(set(self.batches()) - set(merged["batches"]))
        return [merged["folder"]] * bool(merged["folder"]) + [self._files.read(f"commits/{x}").decode() for x in rest]

    def _deltas(self, merged: dict) -> DataFrame:
        folders = self._folders(merged)
        return self.spark.read.schema(DELTA).parquet(*map(self._files.full, folders)) if folders else self.spark.createDataFrame([], DELTA)

    def merge(self) -> bool:
        """Sums the deltas of all batches so far into one; False if another writer merged first. Batch ids stay taken."""
        merged = self._merged()
        batches = self.batches()
        rest = [self._files.read(f"commits/{x}").decode() for x in batches if x not in set(merged["batches"])]
        folders = [merged["folder"]] * bool(merged["folder"]) + rest
        if not rest:
            return False
        folder = self._staged(self.spark.read.schema(DELTA).parquet(*map(self._files.full, folders)))
        if self._files.write_new(f"merges/{merged['number'] + 1}", json.dumps({"folder": folder, "batches": batches}).encode()):
            return True
        self._files.delete(folder)
        return False

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and tokenizer version."""
        total = self._deltas(self._merged()).groupBy(*GROUP).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return total.where("n_docs != 0 OR n_tokens != 0")
