"""Families of synthetic events: each has words and sentences of its own, with slots that a row's number fills.

A family is a table row for each section: sentence patterns and the words for their slots. The sequence of rows is joined to
it and expanded, so a family can be added as data, and no two of them share a sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import lexicon as L

#: By family: words of its slots, and sentences of its sections. {day}, {clock}, {record} and {initials} are any family's.
FAMILIES: dict[str, dict] = {
    "greenhouse vents": {
        "slots": {"vent": ["ridge vent", "louvre panel", "roof hatch"], "crop": ["seedlings", "tomato trays", "fern pots"], "bay": ["bay two", "the propagation bay", "the east bay"]},
        "situation": ["{day} {clock}: the {vent} over {bay} froze half open ({record}).", "Gardeners found the {vent} of {bay} jammed at {clock} on {day} ({record})."],
        "impact": ["The {crop} were left in a draught.", "Nobody has yet looked at the {crop}."],
        "agencies_contacted": ["Phoned Estates ({initials}) about the motor.", "Nobody outside the nursery was told."],
        "action": ["Cranked it shut by hand.", "Draped fleece over the {crop}."],
        "plan": ["Estates bring a spare motor on Tuesday.", "Wait for the next warm day before it is tried again."],
    },
    "choir booking": {
        "slots": {"hall": ["chapel hall", "recital room", "upper gallery"], "group": ["evening choir", "children's choir", "madrigal group"], "paper": ["hire sheet", "booking card", "key register"]},
        "situation": ["The {group} and a quiz were both written on the {paper} for the {hall} ({record}), noticed {day} {clock}.", "At {clock} on {day} two groups stood before the {hall}; the {paper} ({record}) names both."],
        "impact": ["Rehearsal of the {group} began forty minutes late.", "No rehearsal was lost."],
        "agencies_contacted": ["Spoke with the verger ({initials}).", "The quiz master was reached by post only."],
        "action": ["Crossed out the older line on the {paper}.", "Gave the {group} the vestry for the evening."],
        "plan": ["The verger rewrites the {paper} before Sunday.", "No decision yet on who keeps the {hall}."],
    },
    "ferry manifest": {
        "slots": {"boat": ["morning ferry", "car ferry", "island launch"], "list": ["passenger list", "vehicle list", "freight list"], "pier": ["north pier", "stone pier", "outer pier"]},
        "situation": ["Purser of the {boat} counted one more than the {list} showed at the {pier}, {day} {clock} ({record}).", "{record}: on {day} the {list} of the {boat} came ashore unsigned at {clock}."],
        "impact": ["Departure slipped by one tide.", "Whether anyone was left behind is unknown."],
        "agencies_contacted": ["Harbour office informed ({initials}).", "Radioed the coast station ({initials})."],
        "action": ["Recounted along the gangway.", "Copied the {list} and stamped it."],
        "plan": ["Harbour office audits the {list} next week.", "The purser will ask the relief crew."],
    },
    "museum humidity": {
        "slots": {"case": ["display case nine", "coin cabinet", "map drawer"], "meter": ["hygrometer", "data logger", "dial gauge"], "thing": ["parchment", "lacquer box", "silk banner"]},
        "situation": ["The {meter} in the {case} read eighty per cent on {day} at {clock} ({record}).", "Conservator reported a fogged {case} ({record}); the {meter} had stopped at {clock} on {day}."],
        "impact": ["The {thing} shows no cockling.", "Effect on the {thing} not assessed."],
        "agencies_contacted": ["Wrote to the lender ({initials}).", "Called the climate contractor ({initials})."],
        "action": ["Put fresh silica into the {case}.", "Moved the {thing} to quarantine."],
        "plan": ["Read the {meter} each noon until Friday.", "Lender decides whether the {thing} travels."],
    },
    "orchard weighing": {
        "slots": {"fruit": ["russet apples", "late plums", "quinces"], "scale": ["platform scale", "hanging balance", "truck scale"], "lane": ["lane four", "the lower lane", "the wall row"]},
        "situation": ["Crates of {fruit} from {lane} weighed light twice on the {scale}, {day} {clock} ({record}).", "On {day} at {clock} the {scale} drifted while {fruit} were tallied ({record})."],
        "impact": ["Pickers of {lane} were paid from the older tally.", "The difference is not known yet."],
        "agencies_contacted": ["Asked the weights inspector ({initials}) for a date.", "The cooperative ({initials}) was told by phone."],
        "action": ["Zeroed the {scale} with the brass weight.", "Set the crates of {fruit} aside unsold."],
        "plan": ["Inspector seals the {scale} on the tenth.", "Weigh {lane} again once it is dry."],
    },
    "tram signage": {
        "slots": {"stop": ["Mill Street stop", "depot loop", "hospital stop"], "sign": ["departure board", "enamel plate", "route blind"], "line": ["line six", "the night line", "the ring line"]},
        "situation": ["The {sign} at {stop} announced {line} an hour early, {day} {clock} ({record}).", "Riders at {stop} photographed a wrong {sign} ({record}) at {clock} on {day}."],
        "impact": ["A dozen riders missed {line}.", "No complaints have come in."],
        "agencies_contacted": ["Dispatch ({initials}) confirmed by radio.", "Left word with the sign shop ({initials})."],
        "action": ["Taped a paper notice beneath the {sign}.", "Restarted the controller of the {sign}."],
        "plan": ["Sign shop swaps the {sign} overnight.", "Dispatch compares timetables of {line} on Monday."],
    },
    "clinic post": {
        "slots": {"letter": ["referral letter", "appointment card", "consent form"], "tray": ["blue tray", "outgoing tray", "porter's bag"], "ward": ["day ward", "eye ward", "outpatient desk"]},
        "situation": ["A {letter} for the {ward} lay in the {tray} since {day} {clock} ({record}).", "The {ward} opened a {letter} meant for another, {clock} on {day} ({record})."],
        "impact": ["One visit had to be rearranged.", "No visit was affected."],
        "agencies_contacted": ["The post room ({initials}) knows.", "Apologised to the addressee's practice ({initials})."],
        "action": ["Walked the {letter} over in a sealed envelope.", "Noted it in the misroute book."],
        "plan": ["Post room relabels the {tray}.", "The {ward} phones once the {letter} is answered."],
    },
    "theatre props": {
        "slots": {"prop": ["brass lantern", "painted clock", "folding throne"], "scene": ["second act", "ballroom scene", "epilogue"], "store": ["prop cage", "under-stage store", "scene dock"]},
        "situation": ["Before the {scene} the {prop} was missing from the {store}, {day} {clock} ({record}).", "Stagehands signed out the {prop} twice ({record}); found at {clock} on {day}."],
        "impact": ["The {scene} was played without it.", "The audience cannot have noticed."],
        "agencies_contacted": ["Asked the touring company ({initials}).", "House manager ({initials}) was beside us."],
        "action": ["Built a stand-in from card.", "Searched the {store} shelf by shelf."],
        "plan": ["Tag every prop before the matinee.", "Company returns the {prop} with the truck."],
    },
    "river gauge": {
        "slots": {"gauge": ["staff gauge", "float recorder", "sonde"], "reach": ["weir pool", "mill race", "upper ford"], "chart": ["drum chart", "level book", "telemetry page"]},
        "situation": ["The {chart} of the {reach} went flat after {clock} on {day} ({record}).", "Volunteer read the {gauge} at the {reach} two hands below the {chart}, {day} {clock} ({record})."],
        "impact": ["Flood desk worked from the old curve.", "Consequences downstream unconfirmed."],
        "agencies_contacted": ["Rang the hydrology duty line ({initials}).", "The miller ({initials}) was shown the {chart}."],
        "action": ["Scraped weed from the {gauge}.", "Chalked the true level on the {reach} wall."],
        "plan": ["Duty line sends a diver if it stays flat.", "Second reading at first light."],
    },
    "bakery oven log": {
        "slots": {"oven": ["deck oven", "stone oven", "proving cabinet"], "batch": ["rye batch", "brioche batch", "sourdough batch"], "dial": ["steam dial", "thermostat", "timer wheel"]},
        "situation": ["The {dial} of the {oven} spun freely during the {batch}, {day} {clock} ({record}).", "Night baker logged the {oven} cold at {clock} on {day} ({record})."],
        "impact": ["The {batch} was given away.", "All loaves left on time."],
        "agencies_contacted": ["Fitter promised a call back ({initials}).", "Told the shop next door ({initials})."],
        "action": ["Finished the {batch} in the small oven.", "Wedged the {dial} with a cork."],
        "plan": ["Fitter looks at the {dial} after the holiday.", "Bake the next {batch} elsewhere."],
    },
}


def family_table(spark: SparkSession, families: dict[str, dict] | None = None) -> DataFrame:
    """family, sections (section, patterns), slots (slot, words): a row for each family."""
    rows = []
    for name, own in (families or FAMILIES).items():
        sections = [(s, own[s]) for s in L.SECTIONS]
        rows.append((name, sections, sorted(own["slots"].items())))
    return spark.createDataFrame(rows, "family string, sections array<struct<section:string,patterns:array<string>>>, slots array<struct<slot:string,words:array<string>>>")


def _chosen(words: Column, *key: Column | str) -> Column:
    """One of an array of words, by a hash of the key."""
    return F.get(words, F.pmod(F.xxhash64(*[F.lit(k) if isinstance(k, str) else k for k in key]), F.size(words)).cast("int"))


def stories(rows: DataFrame, table: DataFrame, seed: str) -> DataFrame:
    """``rows`` (family, n) with ``pieces``: (section, text) of an event of its family; null for a family that ``table`` hasn't.

    A section's sentence and its words are chosen by a hash of seed, family and number, a slot's word once for the whole event.
    """
    n = F.col("n").cast("long")
    common = {
        "day": F.format_string("2031-%02d-%02d", (n % 12 + 1).cast("int"), (n * 5 % 28 + 1).cast("int")), "clock": F.format_string("%02d:%02dZ", (n * 3 % 24).cast("int"), (n * 7 % 60).cast("int")),
        "record": F.format_string("FIC-%s-%03d", F.upper(F.substring(F.regexp_replace("family", "[^a-z]", ""), 1, 4)), n.cast("int")),
        "initials": F.concat(*[F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "family", n), F.lit(26)).cast("int") + 1, F.lit(1)) for k in ("i", "j")]),
    }
    known = rows.join(F.broadcast(table), "family", "left")  # as many rows as there are families
    filled = F.concat(F.array(*[F.struct(F.lit(k).alias("slot"), v.alias("word")) for k, v in common.items()]), F.transform("slots", lambda s: F.struct(s.slot.alias("slot"), _chosen(s.words, seed, "slot", s.slot, F.col("family"), n).alias("word"))))
    known = known.withColumn("filled", filled)
    fill = lambda pattern: F.aggregate("filled", pattern, lambda t, s: F.replace(t, F.concat(F.lit("{"), s.slot, F.lit("}")), s.word))
    pieces = F.transform("sections", lambda s: F.struct(s.section.alias("section"), fill(_chosen(s.patterns, seed, "pattern", s.section, F.col("family"), n)).alias("text")))
    return known.withColumn("pieces", pieces).select(*rows.columns, "pieces")
