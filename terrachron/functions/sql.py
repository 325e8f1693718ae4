"""SQL functions a user can call by name; Catalyst inlines them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from terrachron.functions import dates, routes


def _pad(which: str) -> str:
    last = (
        f"element_at(array({', '.join(map(str, dates.DAYS_OF_MONTH))}), m)"
        " + if(m = 2 and ((y % 4 = 0 and y % 100 <> 0) or y % 400 = 0), 1, 0)"
    )
    month, day = ("1", "1") if which == "start" else ("12", "last")
    pattern = dates.PARTIAL_DATE.replace("\\", "\\\\")
    group = [f"regexp_extract(value, '{pattern}', {i})" for i in range(1, 5)]
    return f"""(
      select if(y is not null and m between 1 and 12 and d between 1 and last,
                concat(s, lpad(t, 4, '0'), '-', lpad(string(m), 2, '0'), '-', lpad(string(d), 2, '0')), null)
      from (select s, t, y, m, last, coalesce(d0, {day}) as d
            from (select *, if(m between 1 and 12, {last}, 0) as last
                  from (select {group[0]} as s, {group[1]} as t,
                               case when {group[1]} = '' then null
                                    when {group[0]} = '-' then 1 - int({group[1]})
                                    else int({group[1]}) end as y,
                               coalesce(int(nullif({group[2]}, '')), {month}) as m,
                               int(nullif({group[3]}, '')) as d0))))"""


def _decimal_year(text: str) -> str:
    return (
        f"if(startswith({text}, '-'), 1 - int(substring({text}, 2, 4)), int(substring({text}, 1, 4)))"
    )


def definitions() -> dict[str, str]:
    """Name to ``CREATE TEMPORARY FUNCTION`` text."""
    base = " ".join(f"when '{k}' then {v}" for k, v in routes.BASE_SCORE.items())
    bonus = " ".join(f"when network rlike '{p}' then {v}" for p, v in routes.NETWORK_BONUS)
    year = _decimal_year("value")
    before = f"element_at(array({', '.join(map(str, dates.DAYS_BEFORE_MONTH))}), int(substring(value, -5, 2)))"
    leap = f"(({year} % 4 = 0 and {year} % 100 <> 0) or {year} % 400 = 0)"
    leap_of_value = "((int(floor(value)) % 4 = 0 and int(floor(value)) % 100 <> 0) or int(floor(value)) % 400 = 0)"
    body = {
        "as_numeric": (
            "value string",
            "double",
            "if(value is null, null, coalesce(try_cast(value as double), -1d))",
        ),
        "pad_date": (
            "value string, which string",
            "string",
            f"case which when 'start' then {_pad('start')} when 'end' then {_pad('end')} end",
        ),
        "isodatetodecimaldate": (
            "value string",
            "double",
            f"if(value rlike '^-?\\\\d{{4}}-\\\\d{{2}}-\\\\d{{2}}$', "
            f"{year} + ({before} + int(substring(value, -2, 2)) "
            f"+ if({leap} and int(substring(value, -5, 2)) > 2, 1, 0) - 0.5d) / if({leap}, 366, 365), null)",
        ),
        "convert_decimal_to_iso_date": (
            "value double",
            "string",
            "if(value between -9998 and 9999.999999, concat("
            "if(floor(value) < 1, concat('-', lpad(string(abs(floor(value) - 1)), 4, '0')), "
            "lpad(string(floor(value)), 4, '0')), "
            f"substring(string(date_add(if({leap_of_value}, date'2000-01-01', date'2001-01-01'), "
            f"int(greatest(ceil((value - floor(value)) * if({leap_of_value}, 366, 365)), 1)) - 1)), 5, 6)), null)",
        ),
        "is_date_valid": (
            "value string",
            "boolean",
            "coalesce(value rlike '^\\\\d{4}(-\\\\d{2}(-\\\\d{2})?)?$' and not startswith(value, '0000') "
            "and try_to_date(rpad(value, 10, '-01-01'), 'yyyy-MM-dd') is not null "
            "or (length(value) = 7 and try_to_date(concat(value, '-01'), 'yyyy-MM-dd') is not null "
            "and not startswith(value, '0000')), false)",
        ),
        "route_priority": (
            "type string, network string, ref string",
            "decimal(20,0)",
            f"cast(case type {base} else {routes.OTHER_SCORE} end + case {bonus} else 0 end "
            "+ if(type <=> 'road', "
            "(100 - length(coalesce(network, '')) + length(replace(coalesce(network, ''), ':', ''))) * 1000000000L "
            "+ 1000000 - coalesce(try_cast(regexp_replace(ref, '\\\\D', '') as int), 999999), "
            "1000 - length(coalesce(network, ''))) as decimal(20,0))",
        ),
    }
    return {
        name: f"create or replace temporary function {name}({args}) returns {kind} return {text}"
        for name, (args, kind, text) in body.items()
    }


def register(spark: SparkSession) -> list[str]:
    """Register every function in this session and return the names."""
    texts = definitions()
    for text in texts.values():
        spark.sql(text)
    return list(texts)
