"""Contract checks, key checks, quarantine and masking. Every check returns the violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ledgerlake.schemas import Contract

VALID, QUARANTINED = "valid", "quarantined"


def schema_problems(df: DataFrame, contract: Contract) -> list[str]:
    """Differences between a DataFrame's schema and the contract, without reading data."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    want = {f.name: f.dataType.simpleString() for f in contract.schema}
    problems = [f"missing column {name}" for name in want if name not in have]
    problems += [f"unexpected column {name}" for name in have if name not in want]
    problems += [
        f"column {name} is {have[name]}, expected {kind}"
        for name, kind in want.items()
        if name in have and have[name] != kind
    ]
    return problems


def _not_null_rules(contract: Contract) -> dict[str, Column]:
    return {f"{f.name}_null": F.col(f.name).isNull() for f in contract.schema if not f.nullable}


def _length_rules(contract: Contract) -> dict[str, Column]:
    return {f"{name}_too_long": F.length(name) > limit for name, limit in contract.max_lengths.items()}


def _domain_rules(contract: Contract) -> dict[str, Column]:
    rules = {f"{name}_domain": ~F.col(name).isin(*values) for name, values in contract.domains.items()}
    rules |= {f"{name}_minimum": F.col(name) < low for name, low in contract.minimums.items()}
    return rules


def contract_rules(contract: Contract) -> dict[str, Column]:
    """Not-null and length rules; a rule is true when broken."""
    return _not_null_rules(contract) | _length_rules(contract)


def row_rules(contract: Contract) -> dict[str, Column]:
    return contract_rules(contract) | _domain_rules(contract)


def broken_rules(rules: dict[str, Column]) -> Column:
    """Names of the broken rules of a row; a rule that is null counts as kept."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))


def _violations(df: DataFrame, contract: Contract, rules: dict[str, Column]) -> DataFrame:
    return df.select(
        F.lit(contract.name).alias("table_name"),
        F.col(contract.primary_key).alias("row_key"),
        F.explode(broken_rules(rules)).alias("rule"),
    )


def contract_violations(df: DataFrame, contract: Contract) -> DataFrame:
    return _violations(df, contract, contract_rules(contract))


def check_violations(df: DataFrame, contract: Contract) -> DataFrame:
    return _violations(df, contract, _domain_rules(contract))


def split_quarantine(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and failing rows with their reasons; both are narrow scans of the input."""
    marked = df.withColumn("reasons", broken_rules(row_rules(contract)))
    return marked.filter(F.size("reasons") == 0).drop("reasons"), marked.filter(F.size("reasons") > 0)


def write_outcomes(df: DataFrame, contract: Contract, path: str) -> tuple[DataFrame, dict[str, int]]:
    """Write every row below ``path`` under its outcome, ``valid`` or ``quarantined``, with its reasons.

    One job with one scan of ``df`` writes both and counts them; returns the written rows and the counts.
    """
    seen = Observation()
    marked = marked_rows(df, contract)
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in (VALID, QUARANTINED)]
    marked.observe(seen, *counts).write.mode("overwrite").partitionBy("outcome").parquet(path)
    return df.sparkSession.read.schema(marked.schema).parquet(path), seen.get


def marked_rows(df: DataFrame, contract: Contract) -> DataFrame:
    """Rows with their reasons and outcome."""
    marked = df.withColumn("reasons", broken_rules(row_rules(contract)))
    return marked.withColumn("outcome", F.when(F.size("reasons") == 0, VALID).otherwise(QUARANTINED))


def duplicate_keys(df: DataFrame, contract: Contract) -> DataFrame:
    """Keys found more than once, for the primary key and every unique column."""
    found = [
        df.filter(F.col(name).isNotNull())
        .groupBy(F.col(name).cast("string").alias("key_value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(F.lit(contract.name).alias("table_name"), F.lit(name).alias("key_name"), "key_value", "n")
        for name in (contract.primary_key, *contract.unique)
    ]
    return reduce(DataFrame.unionByName, found)


def orphans(child: DataFrame, child_name: str, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Foreign keys without a parent, with the number of rows that carry them.

    Rows are counted per key before the join, so a hot key reaches the join as one row.
    """
    used = child.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key_value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return used.join(
        parent.select(F.col(parent_key).alias("key_value")), "key_value", "left_anti"
    ).select(F.lit(child_name).alias("table_name"), F.lit(key).alias("key_name"), "key_value", "n")


def tokenise(value: Column, salt: str) -> Column:
    """A stable pseudonym: equal inputs give equal tokens."""
    return F.sha2(F.concat(F.lit(salt), value), 256)


def mask_email(email: Column) -> Column:
    return F.regexp_replace(email, r"^(.)[^@]*", "$1***")


def mask_customers(customers: DataFrame, salt: str) -> DataFrame:
    """Names and e-mail hidden, address dropped to its length class, join key tokenised."""
    return customers.withColumns(
        {
            "customer_token": tokenise(F.col("customer_id"), salt),
            "first_name": F.concat(F.substring("first_name", 1, 1), F.lit("***")),
            "last_name": F.concat(F.substring("last_name", 1, 1), F.lit("***")),
            "email": mask_email(F.col("email")),
            "address_line": F.when(F.col("address_line").isNotNull(), F.lit("***")),
        }
    ).drop("customer_id")
