"""Registered source/sink operators (S-01, S-03, S-07, S-08, S-09, S-11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyops.plans import reports as R
from skyops.plans import search as Srch
from skyops.plans.catalog import AS_OF, asof, query
from skyops.plans.q_reports import SQL_R4_BODY
from skyops.sources import tables as S



@query("scan_table", "SELECT * FROM aircrew")
def _s01(t):
    return t.aircrew.orderBy("Last_name", "First_name", "ID")


@query("param_query", """
SELECT ID, Status FROM flight WHERE Origin_airport = 'NATION_1' AND Status IN ('Active', 'Full')
""")
def _s03(t):
    spark = t.flight.sparkSession
    t.flight.createOrReplaceTempView("skyops_flight")
    return S.run_sql(spark, "SELECT ID, Status FROM skyops_flight WHERE Origin_airport = :origin "
                            "AND Status IN (:s1, :s2)", {"origin": "NATION_1", "s1": "Active", "s2": "Full"})


@query("insert_or_ignore", """
SELECT * FROM phone_number_member
UNION ALL
SELECT DISTINCT n.Email, n.Phone_number FROM (
  SELECT Email, '050' || Passport_number AS Phone_number FROM member
  UNION ALL SELECT Email, '053' || Passport_number FROM member) n
WHERE NOT EXISTS (SELECT 1 FROM phone_number_member p WHERE p.Email = n.Email AND p.Phone_number = n.Phone_number)
""")
def _s07(t):
    m = t.member
    new = m.select("Email", F.concat(F.lit("050"), "Passport_number").alias("Phone_number")).unionByName(
        m.select("Email", F.concat(F.lit("053"), "Passport_number").alias("Phone_number")))
    return S.insert_ignore(t.phone_number_member, new, ["Email", "Phone_number"])


@query("upsert", """
WITH n AS (SELECT 'g' || CAST(c_custkey AS VARCHAR) || '@example.com' AS Email,
                  CASE WHEN c_custkey % 7 <> 0 THEN upper(c_name) END AS Last_name_in_English
           FROM customer WHERE c_custkey % 3 <> 1)
SELECT COALESCE(g.Email, n.Email) AS Email, g.First_name_in_English,
       CASE WHEN n.Email IS NOT NULL THEN n.Last_name_in_English ELSE g.Last_name_in_English END AS Last_name_in_English
FROM guest g FULL OUTER JOIN n ON n.Email = g.Email
""")
def _s08(t):
    # guests are the customers of remainder 0; those of remainder 2 are new. Every new row comes twice,
    # the second, later one with another name; every seventh name is NULL
    c = t.raw("customer").where(F.col("c_custkey") % 3 != 1)
    email = F.concat(F.lit("g"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("Email")
    first = c.select(email, F.lit(1).alias("seq"), F.when(F.col("c_custkey") % 7 != 0, F.upper("c_name")).alias("Last_name_in_English"))
    second = c.select(email, F.lit(2).alias("seq"), F.col("c_name").alias("Last_name_in_English"))
    return S.upsert(t.guest, first.unionByName(second), ["Email"], ["Last_name_in_English"], ["seq"])


@query("conditional_update", f"""
SELECT ID, CASE WHEN hit THEN 'Full' ELSE Status END AS Status, CASE WHEN hit THEN dep_ts + INTERVAL 90 MINUTE ELSE dep_ts END AS dep_ts
FROM (SELECT *, Status = 'Active' AND dep_ts < TIMESTAMP '{AS_OF}' + INTERVAL 30 DAY AS hit FROM flight)
""")
def _s09(t):
    pred = (F.col("Status") == "Active") & (F.col("dep_ts") < F.timestamp_add("DAY", F.lit(30), asof()))
    later = F.timestamp_add("MINUTE", F.lit(90), F.col("dep_ts"))
    return S.update_where(t.flight, pred, {"Status": "Full", "dep_ts": later}).select("ID", "Status", "dep_ts")


@query("cancellation_text", f"""
WITH r AS ({SQL_R4_BODY}),
top AS (SELECT Month, Cancellation_Rate FROM r ORDER BY Cancellation_Rate DESC, Month LIMIT 1)
SELECT 'Average cancellation rate: ' || format('{{:.2f}}', (SELECT avg(Cancellation_Rate) FROM r)) || '% | Peak month: ' || Month || ' with ' || format('{{:.2f}}', Cancellation_Rate)
  || '% | Months above 10%: ' || coalesce((SELECT string_agg(Month, ', ' ORDER BY Month) FROM r WHERE Cancellation_Rate > 10), 'none')
  || ' | Conclusion: ' || CASE WHEN Cancellation_Rate > 10 THEN 'look into the cancellations of ' || Month ELSE 'rates look stable' END AS value
FROM top
""")
def _s10c(t):
    return S.cancellation_summary_text(R.report_cancel_rate(t))


@query("json_rows", """
SELECT DISTINCT '{"code":"' || f.Origin_airport || '","label":"' || coalesce(a.Label, f.Origin_airport) || '"}' AS json
FROM flight f LEFT JOIN airport a ON a.Code = f.Origin_airport
""")
def _s11(t):
    return S.to_json_rows(Srch.route_origins(t), ["code", "label"])
