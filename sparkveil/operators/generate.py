"""Synthetic records as hashed columns of a key.

A record depends on the seed and its key only, so generation needs no shuffle, scales with
the number of partitions and gives the same rows after a retry. Keys come from a range, a
rate stream or any table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkveil.functions.hashing import hash_uniform

# Fixed values of the generators.
FIRST_NAMES = ("Ann", "Ben", "Carla", "David", "Elena", "Frank", "Grace", "Hugo", "Ines", "Jonas", "Karin", "Liam")
LAST_NAMES = ("Adams", "Brown", "Clark", "Davis", "Evans", "Foster", "Green", "Hughes", "Irwin", "Jones", "King", "Lewis")
CITIES = ("Austin", "Boston", "Chicago", "Denver", "Elgin", "Fresno", "Houston", "Irvine")
STATES = ("CA", "CO", "IL", "MA", "NY", "TX")
DIAGNOSES = ("diabetes", "hypertension", "asthma", "flu")
PRODUCTS = ("Laptop", "Phone", "Tablet", "Headphones")
SENSORS = ("temperature", "humidity", "air_quality")
ICD_CODES = ("J44.0", "E11.9", "I25.9", "M79.3")
RETENTION_CHOICES = (30, 90, 365, 1095)
SETUP_RETENTION = (365, 1095, 2555)
HEALTH_VIOLATIONS = ("expired_consent", "retention_exceeded", "phi_exposure", "unauthorized_access")
FINANCE_VIOLATIONS = ("cross_border_violation", "excessive_collection", "missing_consent", "data_minimization_violation")
MERCHANTS = ("grocery", "gas", "restaurant", "retail", "healthcare")
PAYMENTS = ("credit_card", "debit_card", "bank_transfer", "digital_wallet")
PURPOSES = ("payment_processing", "fraud_detection", "marketing", "analytics")


class Draws:
    """Reproducible draws for one key column."""

    def __init__(self, key: Column, seed: str) -> None:
        self.key, self.seed = key.cast("string"), seed

    def uniform(self, name: str) -> Column:
        return hash_uniform(F.lit(self.seed), F.lit(name), self.key)

    def integer(self, name: str, low: int, high: int) -> Column:
        return (F.floor(self.uniform(name) * (high - low + 1)) + low).cast("bigint")

    def chance(self, name: str, p: float) -> Column:
        return self.uniform(name) < p

    def choice(self, name: str, options: tuple) -> Column:
        values = F.array(*[F.lit(o) for o in options])
        return F.element_at(values, self.integer(name, 1, len(options)).cast("int"))

    def amount(self, name: str, low: float, high: float) -> Column:
        return F.round(self.uniform(name) * (high - low) + low, 2)

    def time(self, name: str, base: Column, days: int) -> Column:
        """A moment in the `days` before `base`."""
        return F.timestamp_add("SECOND", -self.integer(name, 0, days * 86400 - 1).cast("int"), base)

    def digits(self, name: str, n: int) -> Column:
        return F.lpad(self.integer(name, 0, 10**n - 1).cast("string"), n, "0")

    def uuid(self, name: str) -> Column:
        h = F.sha2(F.concat_ws("|", F.lit(self.seed), F.lit(name), self.key), 256)
        cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
        return F.concat_ws("-", *[F.substring(h, start, n) for start, n in cuts])

    def person(self, name: str) -> Column:
        return F.concat_ws(" ", self.choice(f"{name}_first", FIRST_NAMES), self.choice(f"{name}_last", LAST_NAMES))

    def ssn(self, name: str) -> Column:
        return F.concat_ws(
            "-", self.integer(f"{name}1", 100, 999).cast("string"), self.integer(f"{name}2", 10, 99).cast("string"), self.digits(f"{name}3", 4)
        )

    def phone(self, name: str) -> Column:
        return F.concat(
            F.lit("("), self.integer(f"{name}1", 200, 999).cast("string"), F.lit(") "),
            self.integer(f"{name}2", 200, 999).cast("string"), F.lit("-"), self.digits(f"{name}3", 4),
        )

    def email(self, name: str) -> Column:
        return F.concat(F.lower(self.choice(f"{name}_user", FIRST_NAMES)), self.digits(f"{name}_n", 5), F.lit("@example.com"))

    def card(self, name: str) -> Column:
        return F.concat_ws("-", F.lit("4000"), *[self.digits(f"{name}{i}", 4) for i in range(3)])

    def address(self, name: str) -> Column:
        return F.concat(self.integer(f"{name}_no", 1, 9999).cast("string"), F.lit(" Main St, "), self.choice(f"{name}_city", CITIES))


def _flags(d: Draws, rate: float, kind: str) -> list[Column]:
    bad = d.chance("violation", rate)
    return [bad.alias("has_violation"), F.when(bad, F.lit(kind)).alias("violation_type")]


def healthcare(keys: DataFrame, key: str, base_time: Column, rate: float = 0.2, seed: str = "42") -> DataFrame:
    d = Draws(F.col(key), seed)
    bad = d.chance("violation", rate)
    number = F.col(key).cast("string")
    return keys.select(
        d.uuid("id").alias("id"), d.person("patient").alias("patient_name"),
        F.when(bad, d.ssn("ssn")).otherwise(F.concat(F.lit("***-**-"), d.digits("ssn_tail", 4))).alias("ssn"),
        F.when(bad, d.phone("phone")).otherwise(F.lit("***-***-****")).alias("phone"),
        F.when(bad, d.email("email")).otherwise(F.lit("***@***.com")).alias("email"),
        d.choice("diagnosis", DIAGNOSES).alias("diagnosis"), d.time("treatment", base_time, 365).alias("treatment_date"),
        *_flags(d, rate, "phi_exposure"), base_time.alias("timestamp"),
        F.concat(F.lit("MRN"), F.lpad(number, 7, "0")).alias("medical_record_number"), d.person("doctor").alias("doctor_name"),
        F.concat(F.lit("INS"), d.digits("insurance", 6)).alias("insurance_id"),
    )


def financial(keys: DataFrame, key: str, base_time: Column, rate: float = 0.15, seed: str = "42") -> DataFrame:
    d = Draws(F.col(key), seed)
    return keys.select(
        d.uuid("id").alias("id"), d.person("customer").alias("customer_name"),
        F.concat(F.lit("ACC"), F.lpad(F.col(key).cast("string"), 10, "0")).alias("account_number"),
        d.amount("amount", 10, 5000).alias("transaction_amount"), d.time("transaction", base_time, 180).alias("transaction_date"),
        d.choice("city", CITIES).alias("location"), (~d.chance("violation", rate)).alias("consent_given"),
        *_flags(d, rate, "missing_consent"), base_time.alias("timestamp"),
        F.concat(F.lit("CUST"), d.digits("customer_id", 6)).alias("customer_id"),
        d.integer("score", 300, 850).cast("int").alias("credit_score"), d.choice("retention", RETENTION_CHOICES).alias("data_retention_days"),
    )


def ecommerce(keys: DataFrame, key: str, base_time: Column, rate: float = 0.1, seed: str = "42") -> DataFrame:
    d = Draws(F.col(key), seed)
    bad = d.chance("violation", rate)
    return keys.select(
        F.concat(F.lit("ORD"), F.lpad(F.col(key).cast("string"), 8, "0")).alias("order_id"),
        d.email("email").alias("customer_email"), d.person("customer").alias("customer_name"),
        F.when(bad, d.card("card")).otherwise(F.lit("****-****-****-1234")).alias("credit_card"),
        d.address("billing").alias("billing_address"), d.choice("product", PRODUCTS).alias("product_name"),
        d.amount("amount", 50, 2000).alias("order_amount"), d.time("order", base_time, 90).alias("order_date"),
        d.address("shipping").alias("shipping_address"), d.chance("marketing", 0.5).alias("consent_marketing"),
        *_flags(d, rate, "pci_dss_exposure"), base_time.alias("timestamp"),
    )


def iot(keys: DataFrame, key: str, base_time: Column, rate: float = 0.15, seed: str = "42") -> DataFrame:
    d = Draws(F.col(key), seed)
    bad = d.chance("violation", rate)

    def coordinate(name: str, low: int) -> Column:
        exact = d.uniform(name) + F.lit(float(low))
        return F.when(bad, F.round(exact, 6)).otherwise(F.round(exact, 2))

    return keys.select(
        F.concat(F.lit("DEV"), F.lpad(F.col(key).cast("string"), 6, "0")).alias("device_id"),
        d.choice("sensor", SENSORS).alias("sensor_type"), coordinate("lat", 40).alias("location_lat"),
        coordinate("lng", -74).alias("location_lng"), F.round(d.uniform("temp") * 20 + 15, 1).alias("temperature"),
        F.round(d.uniform("hum") * 50 + 30, 1).alias("humidity"), F.concat(F.lit("USER"), d.digits("user", 3)).alias("user_id"),
        d.time("reading", base_time, 1).alias("reading_timestamp"), d.choice("retention", RETENTION_CHOICES).alias("data_retention_days"),
        *_flags(d, rate, "location_privacy"), base_time.alias("timestamp"),
    )


def setup_healthcare(keys: DataFrame, key: str, base_time: Column, rate: float = 0.1, seed: str = "42") -> DataFrame:
    """The 22-column patient record; only an expired consent changes a field."""
    d = Draws(F.col(key), seed)
    kind = F.when(d.chance("violation", rate), d.choice("kind", HEALTH_VIOLATIONS))
    number = F.lpad(F.col(key).cast("string"), 8, "0")
    return keys.select(
        d.uuid("id").alias("patient_id"), d.choice("first", FIRST_NAMES).alias("first_name"), d.choice("last", LAST_NAMES).alias("last_name"),
        F.to_date(d.time("birth", F.timestamp_add("YEAR", F.lit(-18), base_time), 24000)).alias("date_of_birth"),
        d.ssn("ssn").alias("ssn"), d.phone("phone").alias("phone"), d.email("email").alias("email"), d.address("home").alias("address"),
        d.choice("city", CITIES).alias("city"), d.choice("state", STATES).alias("state"), d.digits("zip", 5).alias("zip_code"),
        F.concat(F.lit("MRN"), number).alias("medical_record_number"), d.choice("icd", ICD_CODES).alias("diagnosis_code"),
        d.time("treatment", base_time, 730).alias("treatment_date"), d.person("provider").alias("provider_name"),
        F.concat(F.lit("INS"), number).alias("insurance_id"), d.amount("bill", 100, 5000).alias("billing_amount"),
        (~F.coalesce(kind == "expired_consent", F.lit(False))).alias("consent_status"),
        d.time("consent", F.timestamp_add("DAY", F.lit(-365), base_time), 730).alias("consent_date"),
        d.choice("retention", SETUP_RETENTION).alias("data_retention_days"), kind.alias("violation_type"), base_time.alias("created_timestamp"),
    )


def setup_financial(keys: DataFrame, key: str, base_time: Column, rate: float = 0.08, seed: str = "42") -> DataFrame:
    """The 21-column transaction record; the violation is a label only."""
    d = Draws(F.col(key), seed)
    kind = F.when(d.chance("violation", rate), d.choice("kind", FINANCE_VIOLATIONS))
    octets = [d.integer(f"ip{i}", 1, 254).cast("string") for i in range(4)]
    place = F.concat_ws(",", F.round(d.uniform("lat") * 180 - 90, 6).cast("string"), F.round(d.uniform("lng") * 360 - 180, 6).cast("string"))
    return keys.select(
        d.uuid("customer").alias("customer_id"), F.concat(F.lit("ACC"), F.lpad(F.col(key).cast("string"), 10, "0")).alias("account_number"),
        d.person("customer").alias("full_name"), F.to_date(d.time("birth", F.timestamp_add("YEAR", F.lit(-18), base_time), 22000)).alias("date_of_birth"),
        d.ssn("national").alias("national_id"), d.phone("phone").alias("phone_number"), d.email("email").alias("email_address"),
        d.address("home").alias("home_address"), d.uuid("transaction").alias("transaction_id"), d.amount("amount", 10, 10000).alias("transaction_amount"),
        d.time("when", base_time, 365).alias("transaction_date"), d.choice("merchant", MERCHANTS).alias("merchant_category"),
        d.choice("payment", PAYMENTS).alias("payment_method"), F.concat_ws(".", *octets).alias("ip_address"), d.uuid("device").alias("device_id"),
        place.alias("geolocation"), d.uniform("risk").alias("risk_score"), d.time("consent", base_time, 730).alias("consent_timestamp"),
        d.choice("purpose", PURPOSES).alias("processing_purpose"), kind.alias("violation_type"), base_time.alias("created_timestamp"),
    )


GENERATORS = {
    "healthcare": healthcare, "financial": financial, "ecommerce": ecommerce, "iot": iot,
    "setup_healthcare": setup_healthcare, "setup_financial": setup_financial,
}


def records(spark: SparkSession, kind: str, n: int, base_time: Column, **options) -> DataFrame:
    """`n` records of a kind."""
    return GENERATORS[kind](spark.range(n), "id", base_time, **options)


def record_stream(spark: SparkSession, kind: str, per_second: int, **options) -> DataFrame:
    """Rate-limited record stream; the event time of a record is the time the rate source gave it."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return GENERATORS[kind](ticks, "value", F.col("timestamp"), **options)



