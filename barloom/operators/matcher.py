"""Many rules at once: an index of classes, matched by counting.

A row has one class in each slot (a feature under a family of labels). A rule accepts classes in some
slots and matches a row if as many of them are hit as it has. The index leads from (slot, class) to the
rules that accept it, so a row adds up the lists of its own classes. Rules are data, read from a table:
plans have a column a slot and don't grow with the rules.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rules as R  # noqa: N812

#: Marks of rows and rules that a block has at once.
BLOCK = 1 << 24
#: Accepted classes of rules that a task holds at once; a larger table is matched slice by slice.
HELD = 1 << 20


class Postings:
    """Lists of rules by slot and class. genes: (rule, slot, class), each rule's slots and classes distinct; rules:
    all of them, those without genes too."""

    def __init__(self, rules: list[int], genes: list[tuple[int, int, int]], slots: int):
        import numpy as np

        self.rules = np.array(sorted(rules), np.int64)
        place = {r: k for k, r in enumerate(self.rules.tolist())}
        self.wanted = np.zeros(len(rules), np.int16)
        for rule, _ in {(r, s) for r, s, _ in genes}:
            self.wanted[place[rule]] += 1
        #: By slot: the classes in order, and a row of marks of the rules for each; the last is of no class.
        self.lists: list[tuple] = []
        for slot in range(slots):
            own = [(c, place[r]) for r, s, c in genes if s == slot]
            classes = np.array(sorted({c for c, _ in own}), np.int64)
            marks = np.zeros((len(classes) + 1, len(rules)), np.int16)
            for c, r in own:
                marks[np.searchsorted(classes, c), r] = 1
            self.lists.append((classes, marks))

    def match(self, classes):
        """(rows, rules) marks. classes: by slot, (values, whether there is one) of the rows."""
        import numpy as np

        hits = np.zeros((len(classes[0][0]) if classes else 0, len(self.rules)), np.int16)
        for (known, marks), (values, there) in zip(self.lists, classes, strict=True):
            if len(known):
                at = np.searchsorted(known, values)
                right = there & (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == values)
                hits += marks[np.where(right, at, len(known))]
        return hits == self.wanted


def _marks(batches: Iterable, postings: Postings, slots: int, pick) -> Iterator:
    """Batches without their last `slots` columns, the classes, and with pick(marks) as columns."""
    import numpy as np
    import pyarrow as pa

    block = max(1, min(1024, BLOCK // max(1, len(postings.rules))))
    for batch in batches:
        for s in range(0, batch.num_rows, block):
            part = batch.slice(s, block)
            own = part.columns[part.num_columns - slots :]
            classes = [(c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ~c.is_null().to_numpy(zero_copy_only=False)) for c in own]
            kept, names, columns = pick(postings.match(classes))
            rest = pa.RecordBatch.from_arrays(part.columns[: part.num_columns - slots], part.schema.names[: part.num_columns - slots])
            rest = rest if kept is None else rest.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([*rest.columns, *columns], [*rest.schema.names, *names])


def match(df: DataFrame, slots: list[Column], rules: DataFrame, name: str = "rule") -> DataFrame:
    """df once for each rule that a row matches, with the column name. slots: the row's class in each slot; a null
    class meets no rule that has the slot. rules: rule, slot, class; a slot of null marks a rule
    without genes. Rules beyond HELD genes are matched in slices of whole rules."""
    import numpy as np
    import pyarrow as pa

    genes = rules.select(F.col("rule").cast("long").alias("rule"), F.col("slot").cast("int").alias("slot"), F.col("class").cast("long").alias("class")).distinct()
    slices, width = -(-genes.count() // HELD) or 1, len(slots)
    work = df.select("*", *(c.cast("long").alias(f"_slot{k}") for k, c in enumerate(slots)))
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def pick_of(postings: Postings):
        def pick(marks):
            row, rule = np.nonzero(marks)
            return row, [name], [pa.array(postings.rules[rule])]

        return pick

    out = None
    for part in range(slices):
        own = genes.where(F.pmod(F.xxhash64("rule"), F.lit(slices)) == part).collect() if slices > 1 else genes.collect()  # about HELD rows
        postings = Postings(sorted({g["rule"] for g in own}), [tuple(g) for g in own if g["slot"] is not None], width)
        found = work.mapInArrow(lambda it, p=postings: _marks(it, p, width, pick_of(p)), schema)
        out = found if out is None else out.union(found)
    return out


class Compiled:
    """Text rules as genes: slots are (feature, family of labels) and the symbol."""

    def __init__(self, rules: list[list[str]], columns: list[str]):
        self.slots: dict[tuple[str, str], int] = {}
        self.symbols: dict[str, int] = {}
        self.genes: list[tuple[int, int, int]] = []
        for k, conditions in enumerate(rules):
            features, symbols = R.split_conditions(conditions)
            for c in dict.fromkeys(features):
                name, label = R.parse_condition(c)
                if name not in columns:
                    raise ValueError(f"unknown feature: {name!r}")
                family, number = _class_of(label)
                self.genes.append((k, self._slot(name, family), number))
            self.genes += [(k, self._slot("symbol", "symbol"), self.symbols.setdefault(s, len(self.symbols))) for s in symbols]
        # Two classes in one slot meet in no row, but for symbols, of which any will do.
        self.never = {r for r, s in {(r, s) for r, s, _ in self.genes if s != self.slots.get(("symbol", "symbol"))} if len({c for q, t, c in self.genes if (q, t) == (r, s)}) > 1}

    def _slot(self, name: str, family: str) -> int:
        return self.slots.setdefault((name, family), len(self.slots))

    def columns(self) -> list[Column]:
        out = []
        for name, family in self.slots:
            col = F.col(f"`{name}`")
            if family == "symbol":
                known = F.create_map(*(F.lit(x) for pair in self.symbols.items() for x in pair))
                out.append(F.try_element_at(known, R.normalize_symbol(col)))
            else:
                value = F.when(~F.isnan(col.cast("double")), col)
                out.append(R.bucket(value, family) if family in R.FAMILIES else F.when(value.isin(*set(R.EQUAL.values())), value.cast("long")))
        return out


def _class_of(label: str) -> tuple[str, int]:
    """The family of a label, and its class there; labels with a value are classes of their own family."""
    if label in R.EQUAL:
        return "value", R.EQUAL[label]
    label = R.LONG_NAMES.get(label, label)
    for family, (labels, _) in R.FAMILIES.items():
        if label in labels:
            return family, labels.index(label)
    raise ValueError(f"unknown label: {label!r}")


def first_match(df: DataFrame, rules: list[list[str]], name: str) -> DataFrame:
    """Rows that match a rule, with the smallest number of such a rule."""
    import numpy as np
    import pyarrow as pa

    compiled = Compiled(rules, df.columns)
    postings = Postings(list(range(len(rules))), compiled.genes, len(compiled.slots))
    postings.wanted[list(compiled.never)] = -1  # never reached
    work = df.select("*", *(c.cast("long").alias(f"_slot{k}") for k, c in enumerate(compiled.columns())), F.lit(0).cast("long").alias("_end"))

    def pick(marks):
        row = np.flatnonzero(marks.any(axis=1))
        return row, [name], [pa.array(marks[row].argmax(axis=1).astype(np.int32))]

    width = len(compiled.slots) + 1  # one slot more, which no rule has, so that there always is one
    postings.lists.append((np.zeros(0, np.int64), np.zeros((1, len(rules)), np.int16)))
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.IntegerType())])
    return work.mapInArrow(lambda it: _marks(it, postings, width, pick), schema)
