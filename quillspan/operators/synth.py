"""A seeded population, its five registries with noise, and the sealed truth.

Every draw is a hash of the row's id and a salt, so any partitioning gives the same population. It follows the segment
shares, income and noise rates of the fixed tables below in distribution, not draw by draw.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.normalize import CITIES
from quillspan.sources.shared import materialise

# Shares, rates and ranges.
SEGMENTS = [("ordinary_compliant", 0.46), ("ordinary_nonfiler", 0.17), ("wealthy_compliant", 0.08), ("wealthy_nonfiler", 0.06), ("under_reporter", 0.18), ("proxy_pair", 0.05)]
EVADER_INCOME = 2_500_000
ENGINES = [(700_000, [70, 125, 124]), (1_500_000, [796, 660, 998]), (3_500_000, [1299, 1497, 1329, 1490]), (8_000_000, [1799, 1797, 1999]), (None, [2694, 2982, 2755, 1984, 1991, 2998])]
DESTINATIONS = ["Dubai", "Jeddah", "London", "Istanbul", "Bangkok", "Kuala Lumpur", "Doha", "Toronto"]
NAME_TYPO, CNIC_TYPO, FATHER_MISSING, DOB_MISSING = 0.04, 0.02, 0.15, 0.10
URDU_RATE = {"vehicles": 0.04, "real_estate": 0.15, "utilities": 0.06, "travel": 0.0, "tax_returns": 0.0}
CNIC_RATES = {"vehicles": (0.70, 0.15), "real_estate": (0.80, 0.0), "utilities": (0.55, 0.15), "travel": (0.55, 0.0), "tax_returns": (0.95, 0.0)}
PHONE_RATES = {"vehicles": 0.5, "utilities": 0.4}

#: Spelling, another spelling, Urdu form.
GIVEN = {
    "M": ["Imran Emran عمران", "Bilal Bilaal بلال", "Asif Aasif آصف", "Tariq Tarik طارق", "Kamran Kamraan کامران", "Nadeem Nadim ندیم", "Rashid Rasheed راشد", "Saleem Salim سلیم", "Waqas Vaqas وقاص", "Zubair Zubayr زبیر", "Faisal Faysal فیصل", "Junaid Junayd جنید", "Hamza Hamzah حمزہ", "Yasir Yaser یاسر", "Shahid Shaheed شاہد", "Adnan Adnaan عدنان"],
    "F": ["Ayesha Aisha عائشہ", "Fatima Fatimah فاطمہ", "Sadia Saadia سعدیہ", "Nazia Naziya نازیہ", "Rabia Rabiya رابعہ", "Sana Sanaa ثنا", "Hina Heena حنا", "Maryam Mariam مریم", "Shazia Shaziya شازیہ", "Bushra Boshra بشری", "Samina Sameena ثمینہ", "Tahira Taahira طاہرہ"],
}
FAMILY = ["Khan Khaan خان", "Malik Malick ملک", "Qureshi Quraishi قریشی", "Butt Bhatt بٹ", "Mughal Moghal مغل", "Chaudhry Chowdhry چودھری", "Sheikh Shaikh شیخ", "Abbasi Abasi عباسی", "Baloch Balouch بلوچ", "Ansari Ansaari انصاری", "Hashmi Hashimi ہاشمی", "Rizvi Rizwi رضوی", "Gondal Gundal گوندل", "Afridi Aafridi آفریدی"]
AREAS = ["Model Town", "Gulberg", "Satellite Town", "Cantt", "Johar Town", "Saddar", "Garden Town", "Civil Lines"]


#: People that every population contains, after the drawn ones; what is not listed is drawn as for anyone.
_WEALTH = {"income": 60_000_000, "wealth": 60_000_000, "n_vehicles": 3, "n_estate": 4, "bill": 400_000, "trips": 6, "role": "normal"}
_SON, _TWINS, _COUPLE = ({"house": h, "street": 7, "area": "Model Town", "city": c, "role": "normal"} for h, c in ((811, "Lahore"), (822, "Multan"), (833, "Quetta")))
EDGE_PEOPLE = [
    _WEALTH | {"gender": "M", "files": True, "declared": 0, "is_evader": True},
    _SON | {"first": GIVEN["M"][0], "second": GIVEN["M"][1], "last": FAMILY[0], "father": GIVEN["M"][2], "father2": GIVEN["M"][3], "father3": FAMILY[0], "dob": "1955-03-01"},
    _SON | {"first": GIVEN["M"][0], "second": GIVEN["M"][1], "last": FAMILY[0], "father": GIVEN["M"][0], "father2": GIVEN["M"][1], "father3": FAMILY[0], "dob": "1985-09-09"},
    _TWINS | {"first": GIVEN["M"][4], "second": GIVEN["M"][5], "last": FAMILY[3], "father": GIVEN["M"][6], "father2": GIVEN["M"][7], "father3": FAMILY[3], "dob": "1990-01-15"},
    _TWINS | {"first": GIVEN["M"][9], "second": GIVEN["M"][12], "last": FAMILY[3], "father": GIVEN["M"][6], "father2": GIVEN["M"][7], "father3": FAMILY[3], "dob": "1990-01-15"},
    _WEALTH | {"gender": "M", "files": True, "declared": 58_000_000, "is_evader": False},
    {"income": 20_000_000, "wealth": 20_000_000, "n_vehicles": 0, "n_estate": 2, "bill": 2500, "trips": 8, "files": False, "declared": 0, "is_evader": True, "role": "normal"},
    _COUPLE | {"gender": "M", "role": "principal", "income": 50_000_000, "wealth": 50_000_000, "declared": 900_000, "files": True, "n_vehicles": 1, "n_estate": 0, "bill": 9000, "trips": 0, "is_evader": True},
    _COUPLE | {"gender": "F", "role": "proxy", "income": 0, "wealth": 50_000_000, "declared": 0, "files": False, "n_vehicles": 2, "n_estate": 3, "bill": 150_000, "trips": 0, "is_evader": False},
]


def unit(*salt: str | int, key: str = "pid") -> Column:
    """A number in [0, 1) from the row's key and a salt."""
    return F.pmod(F.xxhash64(F.col(key), *[F.lit(s) for s in salt]), F.lit(1 << 30)).cast("double") / F.lit(float(1 << 30))


def between(low: float, high: float, *salt: str | int, key: str = "pid") -> Column:
    return F.lit(float(low)) + unit(*salt, key=key) * F.lit(float(high - low))


def whole(low: int, high: int, *salt: str | int, key: str = "pid") -> Column:
    return (F.lit(low) + F.floor(unit(*salt, key=key) * (high - low + 1))).cast("int")


def pick(values: list, *salt: str | int, key: str = "pid") -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.floor(unit(*salt, key=key) * len(values)).cast("int"))


def ladder(u: Column, shares: list[tuple[str, float]]) -> Column:
    """D1's weighted draw."""
    out = F.lit(shares[-1][0])
    for k in reversed(range(len(shares) - 1)):
        out = F.when(u < sum(share for _, share in shares[: k + 1]), shares[k][0]).otherwise(out)
    return out


def population(spark: SparkSession, n: int = 10_000, seed: int = 42) -> DataFrame:
    """One row a person, with plans of assets. Proxy pairs are neighbouring ids: the even one owns. The last
    ``len(EDGE_PEOPLE)`` of the ``n`` people (``n`` is even) are the scripted ones."""
    s = seed
    p = spark.range(n).withColumnRenamed("id", "pid")
    pair = F.floor(F.col("pid") / 2)
    p = p.withColumn("pair", pair)
    drawn = ladder(unit("segment", s), SEGMENTS)
    proxied = unit("proxies", s, key="pair") < SEGMENTS[-1][1]
    p = p.withColumn("role", F.when(proxied & (F.col("pid") % 2 == 0), "principal").when(proxied, "proxy").otherwise("normal"))
    p = p.withColumn("segment", F.when(F.col("role") == "principal", "under_reporter").when(F.col("role") == "proxy", "ordinary_nonfiler").when(drawn == "proxy_pair", "ordinary_compliant").otherwise(drawn))
    p = p.withColumn("gender", F.when(F.col("role") == "principal", "M").when(F.col("role") == "proxy", "F").when(unit("gender", s) < 0.7, "M").otherwise("F"))
    normal = F.sqrt(-2 * F.log(F.greatest(unit("n1", s), F.lit(1e-9)))) * F.cos(2 * 3.141592653589793 * unit("n2", s))
    income = F.when(F.col("segment").startswith("ordinary"), F.exp(13.6 + 0.62 * normal)).when(F.col("segment") == "under_reporter", between(3e6, 45e6, "inc", s)).otherwise(between(8e6, 90e6, "inc", s))
    p = p.withColumn("income", income.cast("long"))
    ghost = unit("ghost", s) < 0.6
    declared = F.when(F.col("segment").endswith("_compliant"), F.col("income") * between(0.88, 1.0, "decl", s)).when(F.col("segment") == "under_reporter", F.col("income") * between(0.08, 0.55, "decl", s)).when((F.col("segment") == "wealthy_nonfiler") & ~ghost, between(0, 800_000, "decl", s)).otherwise(0.0)
    p = p.withColumn("files", F.col("segment").isin("ordinary_compliant", "wealthy_compliant", "under_reporter") | ((F.col("segment") == "wealthy_nonfiler") & ~ghost)).withColumn("declared", declared.cast("long"))
    home = F.when(F.col("role") == "normal", F.col("pid")).otherwise(-1 - F.col("pair"))
    p = p.withColumn("home", home)
    p = p.withColumns({
        "city": F.initcap(pick(CITIES, "city", s, key="home")), "house": whole(1, 999, "house", s, key="home"), "street": whole(1, 60, "street", s, key="home"), "area": pick(AREAS, "area", s, key="home"),
        "first": F.when(F.col("gender") == "M", pick(GIVEN["M"], "first", s)).otherwise(pick(GIVEN["F"], "first", s)),
        "second": F.when(F.col("gender") == "M", pick(GIVEN["M"], "second", s)).otherwise(pick(GIVEN["F"], "second", s)),
        "last": F.when(F.col("role") == "proxy", "Bibi Bibi بی‌بی").otherwise(pick(FAMILY, "last", s)),
        "father": pick(GIVEN["M"], "father", s, key="home"), "father2": pick(GIVEN["M"], "father2", s, key="home"), "father3": pick(FAMILY, "last", s, key="home"),
        "cnic": F.concat(F.format_string("%05d", whole(10000, 79999, "c1", s)), F.format_string("%07d", whole(0, 9_999_999, "c2", s)), whole(0, 9, "c3", s).cast("string")),
        "phone": F.concat(F.lit("03"), F.format_string("%09d", whole(0, 999_999_999, "phone", s, key="home"))),
        "dob": F.format_string("%d-%02d-%02d", whole(1950, 2000, "year", s), whole(1, 12, "month", s), whole(1, 28, "day", s)),
    })
    inc = F.col("income")
    n_vehicles = F.when(inc > 8e6, whole(1, 3, "nv", s)).when(inc > 2.5e6, F.when(unit("nv", s) < 0.2, 0).when(unit("nv", s) < 0.9, 1).otherwise(2)).when(inc > 9e5, (unit("nv", s) < 0.6).cast("int")).otherwise((unit("nv", s) < 0.5).cast("int"))
    n_estate = F.when(inc > 8e6, whole(1, 4, "np", s)).when((inc > 3e6) & (unit("np", s) < 0.4), 1).otherwise(0)
    bill = F.greatest(F.lit(2500), (inc * F.when(inc < 8e6, between(0.015, 0.05, "bill", s)).otherwise(between(0.02, 0.06, "bill", s)) / 12).cast("int"))
    trips = F.when(inc > 8e6, whole(1, 8, "trips", s)).when((inc > 2.5e6) & (unit("trip", s) < 0.3), whole(1, 2, "trips", s)).otherwise(0)
    p = p.withColumns({"n_vehicles": n_vehicles, "n_estate": n_estate, "bill": bill, "trips": trips})
    # The owner's wealth stands in the other's name, at the same address.
    owner = p.where("role = 'principal'").select("pair", F.col("income").alias("owner_income"), F.col("n_vehicles").alias("ov"), F.col("n_estate").alias("oe"), F.col("bill").alias("ob"))
    p = p.join(owner, "pair", "left")
    proxy, principal = F.col("role") == "proxy", F.col("role") == "principal"
    p = p.withColumns({
        "wealth": F.when(proxy, F.col("owner_income")).otherwise(inc),
        "n_vehicles": F.when(proxy, F.greatest(F.col("ov") - 1, F.lit(0))).when(principal, F.least(F.col("n_vehicles"), F.lit(1))).otherwise(F.col("n_vehicles")),
        "n_estate": F.when(proxy, F.greatest("oe", F.lit(1))).when(principal, 0).otherwise(F.col("n_estate")),
        "bill": F.when(proxy, F.greatest("ob", F.lit(120_000))).when(principal, F.greatest(F.lit(8000), (F.col("bill") * 0.18).cast("int"))).otherwise(F.col("bill")),
        "trips": F.when(proxy | principal, 0).otherwise(F.col("trips")),
        "income": F.when(proxy, 0).otherwise(inc).cast("long"),
    })
    evader = principal | (~proxy & (F.col("declared") < 0.5 * F.col("income")) & (F.col("income") >= EVADER_INCOME))
    p = p.withColumn("is_evader", evader)
    place = F.col("pid") - (n - len(EDGE_PEOPLE))
    for name in sorted({c for row in EDGE_PEOPLE for c in row}):
        value = F.col(name)
        for k, row in enumerate(EDGE_PEOPLE):
            if name in row:
                value = F.when(place == k, F.lit(row[name])).otherwise(value)
        p = p.withColumn(name, value.cast(p.schema[name].dataType))
    return p.withColumn("person_id", F.format_string("P%07d", "pid"))


def _typo(text: Column, rate: float, *salt: str | int) -> Column:
    """Swap, drop or double one inner letter."""
    k = (F.lit(2) + F.floor(unit("at", *salt, key="rid") * F.greatest(F.length(text) - 3, F.lit(1)))).cast("int")
    kind = unit("kind", *salt, key="rid")
    head, one, two, tail = F.substring(text, F.lit(1), k - 1), F.substring(text, k, F.lit(1)), F.substring(text, k + 1, F.lit(1)), F.substring(text, k + 2, F.length(text))
    made = F.when(kind < 0.4, F.concat(head, two, one, tail)).when(kind < 0.7, F.concat(head, two, tail)).otherwise(F.concat(head, one, one, two, tail))
    return F.when((unit("typo", *salt, key="rid") < rate) & (F.length(text) > 4), made).otherwise(text)


def _name(columns: list[str], urdu: float, *salt: str | int) -> Column:
    """Spellings three to one, an honorific at times, upper case at times, or Urdu; typing errors come on top."""
    roman = F.concat_ws(" ", *[F.get(F.split(c, " "), F.when(unit("spell", c, *salt, key="rid") < 0.75, 0).otherwise(1)) for c in columns])
    roman = F.when(unit("title", *salt, key="rid") < 0.07, F.concat(pick(["Mr. ", "Haji ", "Dr. "], "which", *salt, key="rid"), roman)).otherwise(roman)
    roman = F.when(unit("upper", *salt, key="rid") < 0.05, F.upper(roman)).otherwise(roman)
    script = F.concat_ws(" ", *[F.get(F.split(c, " "), 2) for c in columns])
    return F.when(unit("urdu", *salt, key="rid") < urdu, script).otherwise(roman)


def _cnic(name: str) -> Column:
    full, masked = CNIC_RATES[name]
    u, c = unit("cnic", name, key="rid"), F.col("cnic")
    dashed = lambda x: F.concat_ws("-", F.substring(x, 1, 5), F.substring(x, 6, 7), F.substring(x, 13, 1))
    k = whole(6, 11, "swap", name, key="rid")
    swapped = F.concat(F.substring(c, F.lit(1), k - 1), F.substring(c, k + 1, F.lit(1)), F.substring(c, k, F.lit(1)), F.substring(c, k + 2, F.lit(13)))
    shown = F.when(unit("cnictypo", name, key="rid") < CNIC_TYPO, swapped).otherwise(c)
    return F.when(u < full, F.when(unit("dash", name, key="rid") < 0.7, dashed(shown)).otherwise(shown)).when(u < full + masked, F.concat(F.substring(c, 1, 5), F.lit("-XXXXXXX-"), F.substring(c, 13, 1))).otherwise("")


def _common(people: DataFrame, name: str, tag: str) -> DataFrame:
    """Rows of a registry (one a planned asset) with names, father, birth date and number as recorded."""
    rows = people.withColumn("rid", F.concat_ws(":", F.lit(name), "pid", "k"))
    missing = DOB_MISSING / 2 if name == "tax_returns" else DOB_MISSING
    # A layer of its own: a typing error uses the spelling several times, which nested in one expression outgrows a method.
    rows = rows.withColumns({"_spelled": _name(["first", "second", "last"], URDU_RATE[name], name), "_father": _name(["father", "father2", "father3"], 0.0, "f", name)})
    return rows.withColumns({
        "id": F.format_string(f"{tag}%07d%02d", F.col("pid"), F.col("k").cast("int")),
        "shown": _typo(F.col("_spelled"), NAME_TYPO, "name", name),
        "father_name": F.when(unit("father", name, key="rid") < FATHER_MISSING, "").otherwise(_typo(F.col("_father"), NAME_TYPO, "name", "f", name)),
        "shown_dob": F.when(unit("dob", name, key="rid") < missing, "").otherwise(F.col("dob")),
        "shown_cnic": _cnic(name),
        "shown_phone": F.when(unit("phone", name, key="rid") < PHONE_RATES.get(name, 0.0), F.when(unit("form", key="rid") < 0.5, F.col("phone")).otherwise(F.concat(F.lit("+92"), F.substring("phone", 2, 20)))).otherwise(""),
        "full_address": F.concat(F.lit("House "), F.col("house").cast("string"), F.lit(", Street "), F.col("street").cast("string"), F.lit(", "), F.col("area"), F.lit(", "), F.col("city")),
    })


def registries(people: DataFrame) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """The five registries, ``record_linkage``, and ``persons`` (the truth)."""
    many = lambda n: F.explode(F.when(F.col(n) > 0, F.sequence(F.lit(1), F.col(n).cast("int"))).otherwise(F.array().cast("array<int>")))
    one = people.withColumn("k", F.lit(1))
    v = _common(people.withColumn("k", many("n_vehicles")), "vehicles", "VEH")
    engine = reduce(lambda out, step: F.when(F.col("wealth") <= step[0], pick(step[1], "cc", key="rid")).otherwise(out), reversed(ENGINES[:-1]), pick(ENGINES[-1][1], "cc", key="rid"))
    v = v.withColumn("engine_cc", engine.cast("long")).withColumn("reg_value", (F.col("engine_cc") * between(3200, 4200, "value", key="rid")).cast("long"))
    e = _common(people.withColumn("k", many("n_estate")), "real_estate", "PROP").withColumn("property_value", F.when(F.col("wealth") > 8e6, between(8e6, 1.2e8, "value", key="rid")).otherwise(between(3e6, 1.5e7, "value", key="rid")).cast("long"))
    u = _common(one, "utilities", "UTL")
    t = _common(one.where("trips > 0"), "travel", "TRV").withColumn("destinations", F.array_join(F.slice(F.array(*[F.lit(d) for d in DESTINATIONS]), 1, F.least("trips", F.lit(4))), "; "))
    r = _common(one.where("files"), "tax_returns", "TAX")
    from quillspan.functions.income import annual_tax

    c = F.col
    tables = {
        "vehicles": v.select(c("id").alias("record_id"), c("shown").alias("owner_name"), c("shown_cnic").alias("owner_cnic"), "father_name", c("shown_dob").alias("dob"), "engine_cc", "reg_value", c("shown_phone").alias("phone"), "city"),
        "real_estate": e.select(c("id").alias("record_id"), c("shown").alias("owner_name"), c("shown_cnic").alias("owner_cnic"), "father_name", c("shown_dob").alias("dob"), "property_value", c("full_address").alias("household"), "area", "city"),
        "utilities": u.select(c("id").alias("account_id"), c("shown").alias("consumer_name"), c("shown_cnic").alias("consumer_cnic"), "father_name", c("shown_dob").alias("dob"), c("full_address").alias("address"), c("bill").cast("long").alias("avg_monthly_bill"), c("shown_phone").alias("phone"), "city"),
        "travel": t.select(c("id").alias("record_id"), c("shown").alias("passenger_name"), c("shown_cnic").alias("passport_cnic"), "father_name", c("shown_dob").alias("dob"), c("trips").cast("long").alias("trips_last_year"), "destinations", "city"),
        "tax_returns": r.select(c("id").alias("return_id"), c("shown").alias("filer_name"), c("shown_cnic").alias("filer_cnic"), "father_name", c("shown_dob").alias("dob"), c("declared").alias("declared_income"), annual_tax(c("declared")).cast("long").alias("tax_paid"), "city"),
    }
    links = reduce(DataFrame.unionByName, [x.select(c("id").alias("record_id"), "person_id", F.lit(n).alias("source")) for n, x in (("vehicles", v), ("real_estate", e), ("utilities", u), ("travel", t), ("tax_returns", r))])
    persons = people.select("person_id", "gender", "dob", "cnic", "city", c("income").alias("true_income"), c("declared").alias("declared_income"), F.bround(F.coalesce(c("declared") / F.nullif(c("income"), F.lit(0)), F.lit(0.0)), 3).alias("report_ratio"), (~c("files")).alias("non_filer"), "is_evader", "role", F.when(c("role") == "proxy", F.format_string("P%07d", c("pid") - 1)).otherwise("-1").alias("principal_id"), (c("role") == "principal").alias("uses_proxy"))
    return tables, links, persons


def generate(spark: SparkSession, folder: str, n: int = 10_000, seed: int = 42, csv: bool = False) -> None:
    """Observable tables, each in an order that tells nothing of the people, and, apart from them, the truth."""
    tables, links, persons = registries(materialise(spark, population(spark, n, seed), "population"))
    for name, df in tables.items():
        writer = df.orderBy(F.xxhash64(df.columns[0], F.lit(seed)), df.columns[0]).write.mode("overwrite")
        writer.csv(f"{folder}/observable/{name}.csv", header=True) if csv else writer.parquet(f"{folder}/observable/{name}.parquet")
    links.write.mode("overwrite").parquet(f"{folder}/truth/record_linkage.parquet")
    persons.write.mode("overwrite").parquet(f"{folder}/truth/persons.parquet")
