"""What is still to be collected by agency, and whether what was found agrees with the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K


def result_check(minutes: Column, found: Column, repository: Column) -> Column:
    """Whether links found agree with an agency's flags: a repository must give some, else there are some where there are minutes."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    agrees = F.when(yes(minutes) == yes(found), K.CHECK_OK).otherwise(K.CHECK_CONFLICT)
    return F.when(yes(repository), F.when(yes(found), K.CHECK_OK).otherwise(K.CHECK_EMPTY)).otherwise(agrees)


def flow(registry: DataFrame, held: DataFrame, found: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """One row for each agency of the registry: what its collection does for each type, and the check of its result.

    ``registry``: sigla, link, possui_atas, possui_repositorio (null flags count as false); ``held``: (sigla, tipo) of files that are
    there already; ``found``: (sigla, links) from the search for minutes; ``wanted``: the types to collect, all by default.
    acao_*: sem_url, nao_pedido, sem_atas, ja_coletado, repositorio (links are taken from it) or busca. consulta_programa: whether
    the portal is asked for an integrity program, which does not depend on files held. pendente: some wanted type lacks files
    and can be collected, whether there is a link or not.
    """
    wanted = K.COLLECTED_TYPES if wanted is None else wanted
    has = held.groupBy(F.upper("sigla").alias("s_")).agg(*[F.bool_or(F.coalesce(F.col("tipo") == t, F.lit(False))).alias(f"tem_{t}") for t in K.COLLECTED_TYPES])
    links = found.groupBy(F.col("sigla").alias("f_")).agg(F.sum("links").alias("links_"))
    rows = registry.join(has, F.upper("sigla") == F.col("s_"), "left").join(links, F.col("sigla") == F.col("f_"), "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    url, repository, minutes = F.coalesce(F.col("link") != "", F.lit(False)), flag("possui_repositorio"), flag("possui_atas")

    def action(kind: str) -> Column:
        out = F.when(~url, "sem_url")
        if kind == "cig":
            out = out.when(~repository & ~minutes, "sem_atas")
        out = out.when(F.lit(kind not in wanted), "nao_pedido").when(flag(f"tem_{kind}"), "ja_coletado")
        return out.when(repository, "repositorio").otherwise("busca") if kind == "cig" else out.otherwise("busca")

    open_ = F.lit(False)
    for t in wanted:
        can = repository | minutes if t == "cig" else F.lit(True)
        open_ = open_ | (~flag(f"tem_{t}") & can)
    acts = {t: action(t) for t in K.COLLECTED_TYPES}
    some = repository | (acts["cig"] == "ja_coletado") | ((acts["cig"] == "busca") & (F.coalesce("links_", F.lit(0)) > 0))
    return rows.select(
        "sigla",
        *[c.alias(f"acao_{t}") for t, c in acts.items()],
        (url & F.lit("pg" in wanted)).alias("consulta_programa"),
        open_.alias("pendente"),
        F.when(~url, K.CHECK_NO_URL).otherwise(result_check(minutes, some, repository)).alias("verificacao"),
    )
