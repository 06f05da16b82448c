"""The capital account as a table function of SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession, name: str = "capital_account", **account) -> None:
    """Register name(TABLE(...) PARTITION BY plan ORDER BY the order of allocation): the trade log
    of each plan. The table has plan and the columns of an entry."""
    import os

    from pyspark.sql.functions import udtf

    from barloom.operators.simulate import LOG

    names = [x.split()[0] for x in LOG.split(", ")]
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

    @udtf(returnType="plan string, " + LOG)
    class Account:
        def __init__(self):
            self.rows = []

        def eval(self, row):
            self.rows.append(row.asDict())

        def terminate(self):
            import sys

            if root not in sys.path:
                sys.path.append(root)
            from barloom.operators.simulate import Account as Rules
            from barloom.operators.simulate import run_account

            if self.rows:
                plan = self.rows[0]["plan"]
                for x in run_account(self.rows, Rules(**account)):
                    yield (plan, *(x.get(n) for n in names))

    spark.udtf.register(name, Account)
