"""Parameters of the service semantics and of the test world.

FIXED VALUES — these must equal the behaviour being reproduced; they are
stated plainly, in natural order, in one place.
"""

from __future__ import annotations

import datetime as _dt

# --- fixed values: service constants -------------------------------------
TOP_K = 10                      # ranking heap size per category
RELATED_MAX_COMPETITORS = 5     # related: at most this many competitors
RELATED_TOTAL = 11              # related: total results
PAGE_SIZE = 10                  # search result page size
COMPETITORS_SHOWN = 4           # competitor rows shown on a profile
SEARCH_MIN_KEY_LEN = 3          # a search key must be longer than 2 chars
SEARCH_MIN_QUERY_LEN = 3        # the UI only sends queries of >= 3 chars
RATE_STD_DIVIDER = 3            # rate thresholds are +-3 standard deviations
HOT_AGE_MONTHS = 42             # age split of the hot / class rules
AGE_OFFSET_MONTHS = 6           # monthly funding divides by (age - 6)
DISPLAY_SCORE_FACTOR = 2250     # success score shown = round(success * 2250)
SCORE_SIGNIFICANT_DIGITS = 5    # per-category score precision
FUNDING_PER_ROUND_DECIMALS = 3  # funding per round precision
INVESTOR_ORGANIZATION = "Organization"
INVESTOR_PERSON = "Person"
ACQUIRED_TAG = "Acquired"

# success classes for acquired companies / acquirers: (upper bound, class)
ACQUIRED_CLASS_BANDS = [(0.1, "bad"), (0.5, "ok"), (0.75, "good"), (0.85, "great"), (None, "awesome")]
ALLSTAR_MIN_SUCCESS = 0.85

# money abbreviation suffixes, smallest first: (threshold, suffix)
MONEY_SUFFIXES = [(1e3, "k"), (1e6, "m"), (1e9, "b"), (1e12, "t")]

# --- fixed values: the test world (see FIXTURES.md) ----------------------
WORLD_AS_OF = _dt.date(2001, 9, 1)
WORLD_EXTRA_CATEGORY = "Unlisted"       # second document category
WORLD_MIN_CATEGORY_SIZE = 100           # baseline cut-off for the world's index size
WORLD_CORRUPT_EVERY = 29                # companies whose document lines each have a junk line beside them
WORLD_LIST_SIZE = 10                    # related lists: list_id = k / 10, pos = k % 10

# search queries: (query_id, text)
WORLD_QUERIES = [
    (1, "red"),
    (2, "bolt red"),
    (3, "wid"),
    (4, "small  gear"),
    (5, "co"),
    (6, "Inc."),
    (7, ""),
]
# queries derived from the part vocabulary get ids from this offset
WORLD_DERIVED_QUERY_BASE = 100

# toy decision trees per category, same JSON shape as the service's model files
WORLD_TREES = {
    "AUTOMOBILE": '{"col":6,"value":"1","tb":{"col":-1,"results":{"1":40}},"fb":{"col":0,"value":"60",'
                  '"tb":{"col":11,"value":"0.6","tb":{"col":-1,"results":{"1":3,"0":1}},"fb":{"col":-1,"results":{"0":20}}},'
                  '"fb":{"col":1,"value":"1-10","tb":{"col":-1,"results":{"1":2}},"fb":{"col":-1,"results":{"0":30}}}}}',
    "BUILDING": '{"col":6,"value":"1","tb":{"col":-1,"results":{"1":40}},"fb":{"col":0,"value":"60",'
                '"tb":{"col":11,"value":"0.6","tb":{"col":-1,"results":{"1":3,"0":1}},"fb":{"col":-1,"results":{"0":20}}},'
                '"fb":{"col":1,"value":"1-10","tb":{"col":-1,"results":{"1":2}},"fb":{"col":-1,"results":{"0":30}}}}}',
    "FURNITURE": '{"col":6,"value":"1","tb":{"col":-1,"results":{"1":25}},"fb":{"col":9,"value":"12",'
                 '"tb":{"col":10,"value":"270000","tb":{"col":-1,"results":{"1":2}},"fb":{"col":-1,"results":{"0":9}}},'
                 '"fb":{"col":1,"value":"","tb":{"col":-1,"results":{"0":5,"1":1}},"fb":{"col":-1,"results":{"0":50}}}}}',
    "HOUSEHOLD": '{"col":6,"value":"1","tb":{"col":-1,"results":{"1":25}},"fb":{"col":9,"value":"12",'
                 '"tb":{"col":10,"value":"270000","tb":{"col":-1,"results":{"1":2}},"fb":{"col":-1,"results":{"0":9}}},'
                 '"fb":{"col":1,"value":"","tb":{"col":-1,"results":{"0":5,"1":1}},"fb":{"col":-1,"results":{"0":50}}}}}',
}

# feature vector slot order (11 training features, then the index score)
VECTOR_SLOTS = [
    "age",
    "num_employees",
    "num_competitors",
    "num_offices",
    "num_products",
    "num_investments",
    "num_acquisitions",
    "num_investors_orgs",
    "num_investors_persons",
    "num_funding_rounds",
    "funding_per_round",
    "s",
]
EMPLOYEES_SLOT = 1
