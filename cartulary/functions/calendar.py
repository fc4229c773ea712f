"""Calendar attributes around the first Sunday of October, the election day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the days, Monday first.
DAY_NAMES = ("segunda", "terca", "quarta", "quinta", "sexta", "sabado", "domingo")
CAMPAIGN_DAYS = 45


def election_day(year: Column) -> Column:
    return F.next_day(F.date_sub(F.make_date(year, F.lit(10), F.lit(1)), 1), "SUN")


def calendar(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """A row for each day of the years, with ISO weeks, phases, events and the media pulse."""
    days = spark.sql(f"select explode(sequence(date'{first_year:04d}-01-01', date'{last_year:04d}-12-31', interval 1 day)) as d")
    days = days.withColumn("election", election_day(F.year("d")))
    days = days.withColumn("campaign", F.date_sub("election", CAMPAIGN_DAYS)).withColumn("opening", F.make_date(F.year("d"), F.lit(1), F.lit(1)))
    d, election, campaign, opening = (F.col(c) for c in ("d", "election", "campaign", "opening"))
    past = F.year("d") < last_year
    before, during = d < campaign, (d >= campaign) & (d <= election)
    event = d.isin(election, campaign, opening)
    ladder = lambda a, b, c: F.when(d == election, a).when(d == campaign, b).when(d == opening, c)
    pulse = F.when(event, "alto").when(during, "medio").when(before, "baixo").otherwise("base")
    week, week_year = F.weekofyear(d), F.expr("extract(yearofweek from d)")
    return days.select(
        F.date_format(d, "yyyyMMdd").alias("tempo_id"),
        F.date_format(d, "yyyy-MM-dd").alias("data"),
        F.year(d).alias("ano"),
        F.month(d).alias("mes"),
        F.dayofmonth(d).alias("dia"),
        week.alias("semana_iso"),
        F.concat(week_year.cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0")).alias("ano_semana_iso"),
        (F.weekday(d) + 1).alias("dia_semana"),
        F.element_at(F.array(*map(F.lit, DAY_NAMES)), F.weekday(d) + 1).alias("nome_dia_semana"),
        F.quarter(d).alias("trimestre"),
        F.year(d).alias("ciclo_eleitoral"),
        F.when(past, "historico_eleitoral").when(during, "janela_campanha").when(before, "pre_campanha").otherwise("pos_eleicao").alias("fase_calendario"),
        past.alias("is_historico_eleitoral"),
        (before & ~past).alias("is_pre_campanha"),
        (during & ~past).alias("is_janela_campanha"),
        event.alias("is_evento"),
        ladder("eleicao_turno_1", "inicio_janela_campanha", "inicio_pre_campanha").alias("evento"),
        ladder("eleitoral_oficial", "campanha", "pre_campanha").alias("tipo_evento"),
        pulse.alias("pulso_midia"),
        pulse.isin("alto", "medio").alias("is_pulso_midia"),
        F.datediff(election, d).alias("dias_ate_eleicao"),
    )
