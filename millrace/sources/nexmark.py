"""Generator of Nexmark-like events: persons, auctions and bids in fixed proportions, made in parallel from the sequence number.

Every value is a function of the seed and the number, so any part of the stream can be made again anywhere. Ids are dense, references point to earlier ids, and times advance by
1 ms with a jitter of at most half the out-of-order bound to either side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = ("phone", "desk", "kiosk", "agent", "feed")
CATEGORIES = 20


@dataclass(frozen=True)
class Config:
    persons: int = 1
    auctions: int = 3
    bids: int = 46
    out_of_order_ms: int = 0
    active_persons: int = 1_000
    active_auctions: int = 10_000
    seed: int = 12_345

    def __post_init__(self):
        if min(self.persons, self.auctions, self.bids) < 0 or self.persons + self.auctions + self.bids < 1:
            raise ValueError("proportions must not be negative, nor all 0")


def of_sequence(numbers: DataFrame, config: Config = Config(), start_ms: int = 0, column: str = "id") -> DataFrame:
    """kind, ts and the structs person, auction and bid, of which one is set, for each sequence number; numbers may be a stream."""
    n, total = F.col(column), config.persons + config.auctions + config.bids
    place, turn = n % total, F.floor(n / total)

    def draw(name: str, limit: Column | int) -> Column:
        """0 .. limit - 1."""
        return F.pmod(F.xxhash64(n, F.lit(name), F.lit(config.seed)), limit if isinstance(limit, Column) else F.lit(limit))

    before_p = turn * config.persons + F.least(place, F.lit(config.persons))
    before_a = turn * config.auctions + F.least(F.greatest(place - config.persons, F.lit(0)), F.lit(config.auctions))

    def earlier(name: str, seen: Column, active: int) -> Column:
        """An id among the first ``active`` that are already there; 1 if there is none."""
        pool = F.greatest(F.least(seen, F.lit(active)), F.lit(1))
        return draw(name, pool) + 1

    jitter = draw("jitter", config.out_of_order_ms + 1) - config.out_of_order_ms // 2 if config.out_of_order_ms else F.lit(0)
    ts = (F.lit(start_ms) + n + 1 + jitter).cast("long")
    is_p, is_a = place < config.persons, place < config.persons + config.auctions
    kind = F.when(is_p, "person").when(is_a, "auction").otherwise("bid")
    name = F.concat(F.lit("person_"), before_p + 1)
    person = F.struct((before_p + 1).cast("long").alias("id"), name.alias("name"), F.concat(name, F.lit("@example.com")).alias("email"), F.format_string("%016d", draw("card", 10**16)).alias("credit_card"), F.concat(F.lit("city_"), draw("city", 15)).alias("city"), F.concat(F.lit("S"), draw("state", 15)).alias("state"), ts.alias("timestamp"))
    auction = F.struct((before_a + 1).cast("long").alias("id"), earlier("seller", before_p, config.active_persons).alias("seller"), (draw("category", CATEGORIES) + 1).alias("category"), (draw("initial", 990) + 10).alias("initial_bid"), (ts + draw("expires", 10_000) + 1_000).alias("expires"), ts.alias("timestamp"))
    channel = F.element_at(F.array(*map(F.lit, CHANNELS)), (draw("channel", len(CHANNELS)) + 1).cast("int"))
    bid = F.struct(earlier("auction", before_a, config.active_auctions).alias("auction"), earlier("bidder", before_p, config.active_persons).alias("bidder"), (draw("price", 9_900) + 100).alias("price"), channel.alias("channel"), ts.alias("timestamp"))
    return numbers.select(n.alias("seq"), kind.alias("kind"), ts.alias("ts"), F.when(is_p, person).alias("person"), F.when(is_a & ~is_p, auction).alias("auction"), F.when(~is_a, bid).alias("bid"))


def events(spark: SparkSession, n: int, config: Config = Config(), start_ms: int = 0) -> DataFrame:
    return of_sequence(spark.range(n), config, start_ms)


def bids(events: DataFrame) -> DataFrame:
    return events.where("kind = 'bid'").select("bid.*", "ts")


def persons(events: DataFrame) -> DataFrame:
    return events.where("kind = 'person'").select("person.*", "ts")


def auctions(events: DataFrame) -> DataFrame:
    return events.where("kind = 'auction'").select("auction.*", "ts")
