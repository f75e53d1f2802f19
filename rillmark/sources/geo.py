"""Geographic lookup of client addresses as joins with a dimension table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an address has that the dimension lacks.
NO_COUNTRY, NO_REGION = "XX", "Unknown"
#: Rows of a dimension that are broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000


def sized(small: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` marked for broadcast if it has at most ``most`` rows."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def with_region(events: DataFrame, geo: DataFrame | None) -> DataFrame:
    """Adds ``geo_country`` and ``region`` from ``geo(client_ip, country, region)``.

    An address has one row in ``geo``; the least of several counts.
    """
    if geo is None:
        return events.withColumn("geo_country", F.lit(NO_COUNTRY)).withColumn("region", F.lit(NO_REGION))
    one = geo.groupBy("client_ip").agg(F.min(F.struct("country", "region")).alias("g")).select(
        "client_ip", F.col("g.country").alias("geo_country"), F.col("g.region").alias("region")
    )
    joined = events.drop("geo_country", "region").join(sized(one), "client_ip", "left")
    return joined.withColumn("geo_country", _or(F.col("geo_country"), NO_COUNTRY)).withColumn("region", _or(F.col("region"), NO_REGION))


def _or(column: Column, default: str) -> Column:
    return F.when(F.coalesce(column, F.lit("")) == "", F.lit(default)).otherwise(column)


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number; null if it isn't one. ``with_region_by_network`` takes IPv6 as well."""
    part = F.split(ip, r"\.")
    octets = [F.get(part, i).try_cast("long") for i in range(4)]
    ok = F.rlike(ip, F.lit(r"^\d{1,3}(\.\d{1,3}){3}$"))
    return F.when(ok, octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3])


def with_region_by_range(events: DataFrame, ranges: DataFrame) -> DataFrame:
    """The same from ``ranges(ip_from, ip_to, country, region)``, which don't overlap.

    Ranges are cut at /16 borders and joined on the border, so the range join is an
    equi-join whose buckets hold the ranges of 65,536 addresses at most.
    """
    cut = ranges.withColumn("block", F.explode(F.sequence(F.floor(F.col("ip_from") / 65536), F.floor(F.col("ip_to") / 65536))))
    cut = cut.select("block", "ip_from", "ip_to", F.col("country").alias("geo_country"), "region")
    wanted = events.select("client_ip").distinct().withColumn("n", ip_number(F.col("client_ip"))).withColumn("block", F.floor(F.col("n") / 65536))
    found = wanted.join(cut, "block").where("n between ip_from and ip_to").select("client_ip", F.col("geo_country").alias("country"), "region")
    return with_region(events, found)


_DIGITS = "0123456789abcdef"


def address_digits(ip: Column) -> Column:
    """An IPv4 address as 8 hexadecimal digits, an IPv6 address as 32, an IPv4 one mapped into IPv6 as 8; null if it is neither."""
    ip = F.regexp_replace(F.lower(ip), r"^::ffff:(?=\d+\.)", "")
    number = ip_number(ip)
    four = F.when(F.rlike(ip, F.lit(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")), F.lpad(F.lower(F.hex(number)), 8, "0"))
    halves = F.split(ip, "::")
    groups = lambda i: F.filter(F.split(F.coalesce(F.get(halves, i), F.lit("")), ":"), lambda g: g != "")
    left, right = groups(0), groups(1)
    missing = F.when(F.size(halves) == 2, F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))).otherwise(0)
    every = F.concat(left, F.array_repeat(F.lit("0"), missing), right)
    fine = F.rlike(ip, F.lit(r"^[0-9a-f:]*:[0-9a-f:]*$")) & (F.size(halves) <= 2) & (F.size(every) == 8) & F.forall(every, lambda g: F.length(g) <= 4)
    return F.coalesce(four, F.when(fine, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), "")))


def network_key(digits: Column, bits: Column) -> Column:
    """Family, length and leading bits of an address, equal for all addresses of a network."""
    whole = (bits / 4).cast("int")
    digit = F.substring(digits, whole + 1, F.lit(1))
    masked = F.lit("")
    for rest in (1, 2, 3):
        step = 16 >> rest
        low = "".join(_DIGITS[i // step * step] for i in range(16))
        masked = F.when(bits % 4 == rest, F.translate(digit, _DIGITS, low)).otherwise(masked)
    return F.concat_ws("/", F.length(digits).cast("string"), bits.cast("string"), F.concat(F.substring(digits, F.lit(1), whole), masked))


def read_networks(spark: SparkSession, paths: str | Sequence[str], network: str = "network", country: str = "country", region: str = "region") -> DataFrame:
    """``network, country, region`` from CSV lists with a header; the three names are those of the file's columns."""
    rows = spark.read.option("header", "true").csv([paths] if isinstance(paths, str) else list(paths))
    return rows.select(F.col(network).alias("network"), F.col(country).alias("country"), F.col(region).alias("region"))


def with_region_by_network(events: DataFrame, networks: DataFrame) -> DataFrame:
    """``geo_country`` and ``region`` from ``networks(network, country, region)``, such as ``10.0.0.0/8`` or ``2001:db8::/32``.

    The longest network that holds an address counts; of equal ones the least row. An address
    without a length is a network of its own. A network that doesn't parse is left out, and an
    address that doesn't has no region. Each address is joined by its leading bits at every length that the table
    has (162 at most), an equi-join without a range condition.
    """
    parts = F.split("network", "/")
    digits = address_digits(F.trim(parts[0]))
    bits = F.when(F.size(parts) == 1, 4 * F.length("digits")).otherwise(F.get(parts, 1).try_cast("int"))
    # the digits are computed once, below the grouping
    known = networks.select(digits.alias("digits"), "network", "country", "region").distinct().withColumn("bits", bits).where("bits between 0 and 4 * length(digits)")
    known = known.groupBy(network_key(F.col("digits"), F.col("bits")).alias("key"), F.length("digits").alias("family"), "bits").agg(
        F.min(F.struct("country", "region")).alias("g")
    )
    lengths = {8: [], 32: []}
    for r in known.select("family", "bits").distinct().collect():
        lengths[r["family"]].append(r["bits"])
    of_family = lambda n: F.array(*map(F.lit, sorted(lengths[n]))).cast("array<int>")
    wanted = events.select("client_ip").distinct().withColumn("digits", address_digits(F.col("client_ip"))).where("digits is not null")
    wanted = wanted.withColumn("bits", F.explode(F.when(F.length("digits") == 8, of_family(8)).otherwise(of_family(32))))
    wanted = wanted.select("client_ip", "bits", network_key(F.col("digits"), F.col("bits")).alias("key"))
    found = wanted.join(sized(known.select("key", "g")), "key").groupBy("client_ip").agg(F.max_by("g", "bits").alias("g"))
    return with_region(events, found.select("client_ip", "g.country", "g.region"))
