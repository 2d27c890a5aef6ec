"""URL filters: allow and block rules by host and path, and a linear model over character n-grams.

The main path uses DataFrame functions only. The model is a logistic regression on hashed
character n-grams of host and path, fitted on the driver from a small labelled URL table,
and its weights are whole numbers, so that a score is the same in any order of summing. Its
intercept is a stated prior.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule
and is judged on the intercept alone, which allows it; repeated rows are judged alike; other columns pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import free

BUCKETS, GRAMS, SCALE = 1 << 16, (3, 4), 1_000
#: Of urls without any n-gram, the share taken to be unwanted; its log odds are the intercept, so that nothing is blocked without a reason.
PRIOR = 0.2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The small labelled URL table, host and path without a scheme: invented ones that advertise, deceive or sell what is not wanted, and ordinary ones.
BLOCKED = """
bestonlinecasino.bet/bonus spinpalace-slots.top/free-spins lucky-casino24.com/register www.royalcasinobonus.net/ casinojackpots.xyz/play?ref=9 megaslots.club/jackpot m.pokerstakes.biz/deposit texas-poker-rooms.info/bonus.html
sportsbets-now.win/odds betting-tips-daily.com/vip livebets.top/football freebet-codes.com/claim rx-pharmacy-online.com/order cheapmeds-rx.net/viagra buy-viagra-cheap.biz/ www.canadianpharma-discount.com/cialis genericpills24.top/cart
slimming-pills-fast.shop/buy dietpills-review.xyz/miracle herbal-viagra.info/order.php cheap-replica-watches.com/rolex replicahandbags.top/sale discount-replicas.shop/ luxuryreplica.biz/watches payday-loans-now.com/apply fastcashloan.top/
no-credit-check-loans.info/apply.php instantpaydayloan.net/ quickloans24.biz/cash easy-credit-repair.xyz/offer work-from-home-cash.com/earn make-money-fast.club/join earn-bitcoin-daily.top/ref/77 double-your-crypto.xyz/invest
free-iphone-winner.top/claim prize-winner-2021.com/claim.php lottery-prize.info/winner youwon.click/gift-card free-giftcards.club/survey win-free-gift.top/survey.html freebies4you.biz/win sweepstakes-winner.xyz/ xxx-tube.biz/hot
freeporn-videos.xyz/ adult-webcams.top/live sexy-singles.club/chat hot-sex-dating.com/join adultdating-finder.biz/ xxxcams.live/free pornmovies.top/hd local-escorts.xyz/girls escort-girls24.com/ hookup-tonight.club/sexy
warez-downloads.net/crack keygen-cracks.info/serial crackedsoftware.top/download free-torrent-movies.xyz/hd torrentwarez.biz/ full-cracked-games.com/torrent serialkeys.click/keygen ads.trackerclicks.com/banner?id=3 adserver.bannerfarm.net/click
click.adtracking.biz/redirect pop-ads-network.com/popunder tracking-pixel.adclick.net/ banner-exchange.info/ads cheap-followers.top/buy buy-instagram-likes.com/cheap seo-backlinks-cheap.biz/order buybacklinks.xyz/
spam-mailer.top/bulk bulk-email-blast.com/spam secure-login-verify.top/account/update account-verify-paypa1.com/login.php bank-login-update.info/verify phishing-kit.xyz/login free-malware-scan.top/download.exe your-pc-infected.click/scan
clickbait-daily.xyz/you-wont-believe shocking-celebrity-news.top/viral miracle-cure-revealed.info/ cheap-deals-outlet.shop/discount-sale discountoutlet.top/cheap free-ringtones.biz/win cheapviagrapills.com/ online-gambling-bonus.net/casino
""".split()
ORDINARY = """
en.wikipedia.org/wiki/Glacier docs.python.org/3/library/json.html www.gutenberg.org/ebooks/1342 www.nature.com/articles/d41586 arxiv.org/abs/1706.03762 www.bbc.co.uk/news/science www.theguardian.com/books/2019/review www.loc.gov/collections/maps
www.nps.gov/yose/planyourvisit www.britannica.com/animal/otter spark.apache.org/docs/latest/sql-ref.html developer.mozilla.org/en-US/docs/Web/HTML stackoverflow.com/questions/11227809 www.kernel.org/doc/html/latest postgresql.org/docs/current/indexes.html
www.w3.org/TR/html52/ www.ietf.org/rfc/rfc3986.txt www.nasa.gov/missions/apollo www.noaa.gov/weather www.usgs.gov/programs/earthquake-hazards www.who.int/news-room/fact-sheets www.cdc.gov/flu/index.htm www.nhs.uk/conditions/asthma
www.metmuseum.org/art/collection www.moma.org/calendar/exhibitions www.britishmuseum.org/visit www.louvre.fr/en/explore www.rijksmuseum.nl/en/stories www.si.edu/exhibitions www.tate.org.uk/art/artists www.bl.uk/collection-items
www.mit.edu/research www.ox.ac.uk/admissions/undergraduate www.stanford.edu/academics www.ethz.ch/de/studium.html www.uni-heidelberg.de/de/forschung www.sorbonne.fr/formation www.unam.mx/investigacion www.cam.ac.uk/colleges
www.lemonde.fr/culture/article/2020/05/12 www.spiegel.de/wissenschaft/mensch elpais.com/cultura/2018-03-01 www.zeit.de/wissen/umwelt www.liberation.fr/societe www.sueddeutsche.de/reise www.elmundo.es/deportes www.nytimes.com/section/travel
www.gov.uk/renew-driving-licence www.bundestag.de/dokumente www.service-public.fr/particuliers europa.eu/youth/home www.un.org/en/about-us www.parliament.uk/business www.cityofboston.gov/parks www.berlin.de/tourismus
www.seattle.gov/transportation www.nyc.gov/schools springfield-library.org/events/story-hour oakhill-elementary.org/calendar lakeside-school.net/parents/newsletter riverton-high-school.org/sports northside-clinic.org/appointments
gardenclub-notes.org/roses/pruning grandmas-kitchen.net/recipes/apple-pie thebreadbaker.com/sourdough/starter simple-vegan-suppers.com/lentil-soup hiking-the-alps.net/routes/day-3 slowtravel-journal.com/portugal/lisbon
birdwatch-diary.org/2014/spring oldmapsonline.org/maps woodworking-bench.com/projects/chair knitting-patterns-shop.com/scarf bikerepair-guide.org/brakes localhistorysociety.org/archive/mill astronomy-club.net/telescopes
photography-walks.com/gallery/harbour chess-openings.org/sicilian classical-music-notes.org/bach/cantatas jazz-records-blog.com/reviews film-review-weekly.com/2017/09 poetry-magazine.org/issues/spring shortstories.net/authors
family-dentist-austin.com/contact smith-law-office.com/our-team harbour-hotel.co.uk/rooms greenvalley-farm.org/visit corner-bookshop.co.uk/new-arrivals village-bakery.net/opening-times homeimprovement-forum.com/thread/4411
parenting-forum.net/topic/sleep linux-users-group.org/meetings rustlang-weekly.dev/issue/88 datasciencehandbook.dev/pandas/groupby statistics-lectures.org/regression chemistry-lab-notes.edu/titration opendata.paris.fr/explore
climate-research-institute.org/reports marinebiology-station.edu/kelp wildlife-trust.org/nature-reserves weather-station-blog.net/rainfall trainspotting-pictures.co.uk/steam community-theatre.org/tickets food-bank-county.org/donate
animal-shelter.org/adopt/dogs maple-street-church.org/services swimming-club.net/timetable marathon-training.org/plan football-league-tables.co.uk/season chess.org/tournaments used-cars-guide.com/reviews mortgage-explained.org/basics
""".split()


class Rule(NamedTuple):
    pattern: str  # host, then a path that starts with /
    verdict: str


RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, 1 for block) of the table; a path ends where path_of() ends it."""
    rows = []
    for label, urls in ((1, BLOCKED), (0, ORDINARY)):
        for url in urls:
            host, slash, path = url.partition("/")
            rows.append((host, slash + path.partition("?")[0], label))
    return rows


def bucket(gram: str) -> int:
    """As gram_bucket, in Python."""
    h = 0
    for c in gram:
        h = (h * 131 + ord(c)) % 1_000_003
    return h % BUCKETS


def fitted(rows: Sequence[tuple[str, str, int]]) -> tuple[int, tuple[int, ...]]:
    """Intercept and weights of the logistic regression on labelled urls, times SCALE."""
    x = np.zeros((len(rows), BUCKETS))
    for i, (host, path, _) in enumerate(rows):
        text = f"^{host}{path}$"
        for n in GRAMS:
            for j in range(len(text) - n + 1):
                x[i, bucket(text[j : j + n])] += 1
    y = np.array([label for *_, label in rows], float)
    used = np.flatnonzero(x.any(axis=0))  # other weights stay 0
    x, ridge, intercept = x[:, used], 0.004, np.log(PRIOR / (1 - PRIOR))
    w, velocity = np.zeros(len(used)), np.zeros(len(used))
    for _ in range(1500):
        p = 1 / (1 + np.exp(-np.clip(x @ w + intercept, -30, 30)))
        velocity = 0.9 * velocity - 0.02 * (x.T @ (p - y) / len(y) * 10 + ridge * w)
        w = w + velocity
    full = np.zeros(BUCKETS)
    full[used] = np.round(w * SCALE)
    return int(np.round(intercept * SCALE)), tuple(map(int, full))


@lru_cache(maxsize=1)
def trained() -> tuple[int, tuple[int, ...]]:
    """The model of the whole table."""
    return fitted(labelled_urls())


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as struct(pattern, verdict), or null."""
    found = F.lit(None).cast("struct<pattern:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        own, slash, rest = rule.pattern.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule.pattern).alias("pattern"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _weight(table: Column, n: int, codes: Column) -> Callable[[Column], Column]:
    """From a place in codes to the weight of the n-gram there."""
    def at(i: Column) -> Column:
        h = F.lit(0).cast("bigint")
        for j in range(n):
            h = (h * 131 + F.get(codes, i + F.lit(j))) % 1_000_003
        return F.get(table, (h % F.lit(BUCKETS)).cast("int"))

    return at


def codes_of(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))


def model_score(codes: Column) -> Column:
    """The intercept plus the weights of the n-grams of a text's codes_of(), a long; above 0 the model blocks."""
    intercept, weights = trained()
    table = F.lit(np.array(weights, np.int64))
    total = F.lit(intercept).cast("bigint")
    for n in GRAMS:
        spots = F.when(F.size(codes) >= n, F.sequence(F.lit(0), F.size(codes) - F.lit(n))).otherwise(F.array().cast("array<int>"))
        total = total + F.aggregate(F.transform(spots, _weight(table, n, codes)), F.lit(0).cast("bigint"), lambda s, w: s + w)
    return total


def judge(df: DataFrame, url: str = "url", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Adds host, path, rule, model_score and verdict to every row; they replace columns of these names."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    codes, rule = free(df, "_codes"), free(df, "_rule")
    out = df.withColumns({"host": host, "path": path}).withColumns({codes: codes_of(F.concat(F.lit("^"), F.col("host"), F.col("path"), F.lit("$"))), rule: longest_rule(F.col("host"), F.col("path"), rules)})
    out = out.withColumn("model_score", model_score(F.col(codes)))
    out = out.withColumns({"rule": F.col(f"{rule}.pattern"), "verdict": F.coalesce(F.col(f"{rule}.verdict"), F.when(F.col("model_score") > 0, "block").otherwise("allow"))})
    return out.drop(codes, rule)


def oracle() -> str:
    intercept, weights = trained()
    grams = " + ".join(
        "list_sum([0] || list_transform(range(0, greatest(len(c) - %d, 0)), lambda i: w[1 + %s]))" % (n - 1, "(" + _horner(n) + f") % {BUCKETS}") for n in GRAMS
    )
    fits = {r.pattern: f"(host = '{r.pattern.partition('/')[0]}' OR ends_with(host, '.{r.pattern.partition('/')[0]}')) AND starts_with(path, '/{r.pattern.partition('/')[2]}')" for r in RULES}
    order = sorted(RULES, key=lambda r: (-len(r.pattern), r.pattern))
    pick = lambda value: "CASE " + " ".join(f"WHEN {fits[r.pattern]} THEN '{value(r)}'" for r in order)
    return f"""
WITH m AS (SELECT {list(weights)}::BIGINT[] AS w),
p AS (SELECT page_id,
  translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
k AS (SELECT *, list_transform(string_split('^' || host || path || '$', ''), lambda x: ord(x)::BIGINT) AS c FROM p),
s AS (SELECT k.*, ({intercept} + {grams})::BIGINT AS model_score FROM k, m)
SELECT page_id, host, path, {pick(lambda r: r.pattern)} END AS rule,
  {pick(lambda r: r.verdict)} WHEN model_score > 0 THEN 'block' ELSE 'allow' END AS verdict, model_score FROM s"""


def _horner(n: int) -> str:
    h = "0"
    for j in range(n):
        h = f"(({h}) * 131 + c[i + {j + 1}]) % 1000003"
    return h
