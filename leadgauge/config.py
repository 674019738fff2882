"""Every constant of the scorecard, as defaults of one frozen config."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import NamedTuple


class Rule(NamedTuple):
    """One first-touch rule: `column LIKE pattern` gives `label`."""

    column: str
    pattern: str
    label: str


class Feature(NamedTuple):
    """One scored column; its highest score is cap x weight."""

    name: str
    cap: int
    weight: int


# E-mail domains that mark an account as personal. The match is exact and case-sensitive.
PERSONAL_DOMAINS = tuple("""
    .ac.uk .edu .se alice.it alunos.uminho.pt aol.com atlas.cz azet.sk blueyonder.co.uk bt.com btinternet.com
    chello.nl cin.ufpe.br com.tw email.com ex.ua fastmail.fm fh-bielefeld.de freenet. freeserve.co.uk games.com
    gamil.com gmai gmai.com gmail gmail.com gmx.co gmx.com gmx.de gmx.net hanmail.net heroku.com hotmail
    hotmail.com hush.com hushmail.com icloud icloud.com iname.com inbox.com itsligo.ie kcl.ac.uk laposte.net
    lavabit.com list.ru live. live.co.uk live.com love.com mac.com mail.com mail.ru me.com mohmal.com my.yorku.ca
    netcourrier.com nmmu.ac.za ntlworld.com o2.co.uk online.ua op.pl orange. orange.net outlook outlook.com
    pobox.com polimi.it qq.com queensu.ca rambler.ru rocketmail.com safe-mail.net sky.com
    talktalk.co.uk te.eg teilar.gr tiscali.co.uk tu-bs.de tut.by ua.pt ucm.es ufrj.br ufv.br ukr.net um.ac.id
    umontreal.ca univ-reims.fr uol.com virgin.net virginmedia.com wanadoo.co.uk web.de wow.com ya.ru yahoo yandex
    yandex.com yandex.ru ygm.com ymail.com zoho.com
""".split())

# Nouns of the app-name generator, matched anywhere in the second part of a name.
NAME_NOUNS = tuple("""
    abyss animal apple atoll aurora autumn bacon badlands ball banana bath beach bear bed bee bike bird boat book
    bowl branch bread breeze briars brook brush bunny candy canopy canyon car cat cave cavern cereal chair chasm
    chip cliff coal coast cookie cove cow crater creek darkness dawn desert dew dog door dove drylands duck dusk
    earth fall farm fern field firefly fish fjord flood flower flowers fog foliage forest freeze frog fu galaxy
    garden geyser gift glass grove guide guru hat hug hero hill horse house hurricane ice iceberg island juice
    lagoon lake land lawn leaf leaves light lion marsh meadow milk mist moon moss mountain mouse nature oasis ocean
    pants peak pebble pine pilot plane planet plant plateau pond prize rabbit rain range reef reserve resonance
    river rock sage salute sanctuary sand sands shark shelter shirt shoe silence sky smokescreen snowflake socks
    soil soul soup sparrow spoon spring star stone storm stream summer summit sun sunrise sunset sunshine surf swamp
    table teacher temple thorns tiger tigers towel train tree truck tsunami tundra valley volcano water waterfall
    waves wild willow window winds winter zebra
""".split())

PAID_MARKETING = "PAID MARKETING"
REFERRALS = "REFERRALS"

# First-touch rules on the landing URL and the growth site, in order; the first match wins. {site} is the
# own site's domain, {name} that without its last part.
URL_RULES = (
    Rule("url", "%utm_source=adwords%", PAID_MARKETING),
    Rule("url", "%utm_medium=email%", "EMAIL"),
    Rule("url", "%utm_medium=referral%", "REFERRALS"),
    Rule("url", "%utm_medium=social%", "SOCIAL"),
    Rule("url", "%?growth%", PAID_MARKETING),
    Rule("referrer", "%growth.{name}%", PAID_MARKETING),
    Rule("url", "%gclid=%", PAID_MARKETING),
)

# Texts looked for anywhere in the referrer, by channel, in order, after the own site's.
REFERRER_TEXTS = (
    ("REFERRALS", """
        github.com laravel.com laracasts.com realtime-notifications.herokuapp.com habrahabr.ru disq.us
        https://medium. http://medium. .medium.com sitepoint.com hackernoon.com producthunt.com codementor.io
        workable.com cloud.google.com laravel-news.com soapbox.gg code.tutsplus.com appcoda.com auth0.com
        techcrunch.com scotch.io jslive.com stackoverflow.com wordpress.org libhunt.com recode.net
        dashboard.heroku.com css-tricks.com tympanus.net barrucadu.co.uk blog.sstorie.com rethinkdb.com tumblr.com
        jplhomer.org learn.fullstackacademy.com murze.be fullstackpython.com vue-chartjs.org d.laravel-china.org
        london.startups-list.com laravel.ru blog.carbonfive.com learninglaravel.net android-app://com.medium.reader
    """),
    ("SOCIAL", """
        hashnode.com segmentfault.com dev.to t.co lobste.rs news.ycombinator.com reddit.com facebook.com twitter.com
        m.facebook.com l.facebook.com away.vk.com youtube.com plus.google.com linkedin.com quora.com
        accounts.youtube.com plus.url.google.com lm.facebook.com meetup.com web.facebook.com amp.reddit.com
        echojs.com javascript.com laravel-news.com frontendfront.com qiita.com android-app://com.twitter.android
        android-app://m.facebook.com android-app://org.telegram.messenger android-app://com.Slack
    """),
    ("ORGANIC", """
        google. bing baidu yandex yahoo ask seznam duckduckgo hn.algolia.com utm_medium=organic
    """),
    ("EMAIL", """
        JSK weekly digest newsletter mail.google.com link.oreilly.com outlook.live.com golangweekly.com mail.qq.com
        accounts.google mailchi.mp react.statuscode.com campaign-archive.com mail01.tinyletterapp.com mail.yahoo.com
        dotnetweekly.com androidweekly.net learninglaravel.net net.litmus.com dotnetweekly.com androiddevdigest.com
        kotlinweekly.net csharpdigest.net cronweekly.com iosdevweekly.com digest.appcoda.com digest.mbltdev.ru
        indieiosfocus.curated.co javascriptweekly.com fivejs.codeschool.com
        smashingmagazine.com/the-smashing-newsletter softwareleadweekly.com umaar.com/dev-tips founderweekly.com
        frontendfoc.us greenruby.org hackingui.com pointer.io hackernewsletter.com thisweekindomains.com wdrl.info
        webopsweekly.com ben-evans.com hndigest.com thejournal.email lastweekinaws.com porter.io
        programmingdigest.net startupresources.io softwareclown codewithoutrules.com/softwareclown
        securitynewsletter.co realtimeweekly.co list-manage.com nodeweekly.com nosqlweekly.com phpweekly.com
        postgresweekly.com mindtheproduct.com/product-management-newsletter newsletter.pythontips.com
        importpython.com/newsletter pythonweekly.com pycoders.com raspiweekly.com reactjsnewsletter.com
        react.statuscode.com reactdigest.net rubyweekly.com scalatimes.com swiftweekly.com swiftnews.curated.co
        arkitweekly.com andybargh.com/swiftdevelopments typescript-weekly.com
        fullstackfeed.com/typescript-newsletter emberweekly.com
    """),
)

REFERRER_RULES = tuple(
    Rule("referrer", f"%{text}%", label) for label, texts in REFERRER_TEXTS for text in texts.split()
)

# Scored columns in report order with the most points a feature may give before weighting.
FEATURES = (
    Feature("dashboard_daily_pageviews", 10, 2),
    Feature("engagement_frequency", 6, 2),
    Feature("number_of_named_apps", 4, 2),
    Feature("tech_info", 2, 2),
    Feature("active_app", 1, 2),
    Feature("multiple_env_flag", 1, 1),
    Feature("collaborators", 1, 1),
    Feature("tut_doc_pv", 1, 1),
    Feature("hit_soft_limit", 1, 1),
)


@dataclass(frozen=True)
class ScorecardConfig:
    """Thresholds, lists and weights; the defaults give the published score of 0..50.

    Some parameters have no useful default. `own_site` is the domain of the site whose accounts are scored: its
    dashboard, blog and growth pages, its own e-mail addresses and referrers follow from it. `own_hosts` are hosts of
    the owner's projects elsewhere, which refer like other sites. `name_adjectives` is the generator's adjective
    vocabulary, of any length; it is too long to keep in code.
    """

    own_site: str = "example.com"
    own_hosts: Sequence[str] = ()
    own_channel: str = "OWN SITE"
    blog_channel: str = "BLOG"
    name_adjectives: Sequence[str] = ()
    name_nouns: Sequence[str] = NAME_NOUNS
    personal_domains: Sequence[str] = PERSONAL_DOMAINS
    url_rules: Sequence[Rule] = URL_RULES
    referrer_rules: Sequence[Rule] = REFERRER_RULES
    paid_mediums: Sequence[str] = ("CPC", "PAID")
    features: Sequence[Feature] = FEATURES

    free_plan_id: int = 1
    signed_up_from: str = "2018-01-01"
    excluded_email: str = "%invalid%"
    window_months: int = 1
    unknown_tech: str = "none"
    active_connections: int = 5
    active_messages: int = 100
    tutorial_asset: str = "tutorials"
    bot_agent: str = "Web Analytics Bot"
    docs_url: str = "%docs%"

    # A flag is set when the number on its left is greater than these.
    tutorials_over: int = 0
    docs_over: int = 1
    connection_limit_over: int = 0
    message_limit_over: int = 1

    tagged_url: str = "%utm_source=%"
    heroku_channel: str = "HEROKU"
    other_channel: str = "OTHER"
    untracked_channel: str = "AD BLOCKER"
    default_channel: str = "DIRECT"

    def __post_init__(self) -> None:
        for name in ("tutorials_over", "docs_over", "connection_limit_over", "message_limit_over"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative: accounts without rows would have to count")

    @property
    def dashboard_url(self) -> str:
        return f"%dashboard.{self.own_site}%"

    @property
    def dashboard_url_excluded(self) -> str:
        return f"%dashboard.{self.own_site}/account%"

    def all_personal_domains(self) -> list[str]:
        return [*self.personal_domains, self.own_site]

    def first_touch_rules(self) -> list[Rule]:
        """All rules on URL and referrer, in order."""
        name = self.own_site.rpartition(".")[0] or self.own_site
        names = {"{site}": self.own_site, "{name}": name}

        def named(rule: Rule) -> Rule:
            pattern = rule.pattern
            for mark, value in names.items():
                pattern = pattern.replace(mark, value)
            return rule._replace(pattern=pattern)

        own = [
            Rule("referrer", f"%blog.{self.own_site}%", self.blog_channel),
            Rule("referrer", f"%https://{self.own_site}%", self.own_channel),
            *(Rule("referrer", f"%{host}%", REFERRALS) for host in self.own_hosts),
        ]
        return [*map(named, self.url_rules), *own, *map(named, self.referrer_rules)]

    def cap(self, feature: str) -> int:
        return next(f.cap for f in self.features if f.name == feature)


def minimal_words(words: Iterable[str]) -> list[str]:
    """Drop words that contain another word of the list; a substring match finds the same strings without them."""
    unique = list(dict.fromkeys(words))
    return [w for w in unique if not any(v != w and v in w for v in unique)]


def live_rules(rules: Iterable[Rule]) -> list[Rule]:
    """Drop `%text%` rules that an earlier rule on the same column always beats."""
    kept: list[Rule] = []
    for rule in rules:
        text = rule.pattern.strip("%")
        plain = rule.pattern == f"%{text}%" and "%" not in text
        beaten = plain and any(
            k.column == rule.column and k.pattern == f"%{t}%" and not set(t) & set("%_\\") and t in text
            for k in kept
            for t in [k.pattern.strip("%")]
        )
        if not beaten:
            kept.append(rule)
    return kept
