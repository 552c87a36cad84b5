"""The blocking-rule catalogue. Rules are plain data, expanded on the driver."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass


@dataclass(frozen=True)
class Part:
    """One component of a block key: a feature, the least length of its value, and a bucket function."""

    source: str
    feature: str
    least: int = 1
    transform: str | None = None

    @property
    def key(self) -> str:
        return f"{self.source}__{self.feature}"


@dataclass(frozen=True)
class Rule:
    name: str
    family: str
    parts: tuple[Part, ...]


# Families by strength, as the evidence formulas use them.
STRONG = ("behavior_context", "behavior_context_device", "cluster_candidate", "postman_context",
          "behavior_daypart", "behavior_daypart_device", "registration_time_window", "identity_rescue")
WEAK = ("context", "coverage_compound", "coverage_fallback")
TIME_AWARE = ("behavior_daypart", "behavior_daypart_device", "registration_time_window")
BEHAVIOR_EVIDENCE = ("behavior", "behavior_context", "behavior_context_device", "cluster_candidate",
                     "postman_context", "behavior_daypart", "behavior_daypart_device")
BEHAVIOR_CONTEXT = ("behavior_context", "behavior_context_device", "postman_context", *TIME_AWARE)

GEO = Part("np", "geoname_id", 2)
REGION = Part("np", "subdivision_1_iso_code", 2)
DEVICE, OS, BROWSER = Part("np", "device"), Part("np", "osfamily"), Part("np", "browser")
ABROAD = Part("np", "is_not_russia")
BUCKET = Part("derived", "registration_60m_bucket", 16)
DOMAIN = Part("derived", "email_domain")
HOUR, DAY = Part("rt", "local_hour", 8, "daypart"), Part("rt", "day", 7, "weekpart")

# Behaviour features, and rules that are defined but not recommended.
BEHAVIORS = ("source_site_365", "source_site_30", "visited_30", "visited_365", "has_account", "has_click_365",
             "has_click_30", "has_accept_365", "has_accept_30", "has_order_365", "has_order_30", "has_view_90")
NOT_RECOMMENDED = ("rule__context__np_subdivision", "rule__context__rt_geoname", "rule__identity_rescue__phone_prefix6",
                   "rule__behavior__fs_source_site_365", "rule__behavior__fs_has_account", "rule__behavior__fs_has_accept_365",
                   "rule__behavior__fs_has_view_90", "rule__coverage__np_subdivision__np_device__np_osfamily")


def fs(feature: str) -> Part:
    return Part("fs", feature)


def catalogue() -> list[Rule]:
    """All 51 rules: single features, then combinations, then families of combinations by behaviour."""
    out = [
        Rule("rule__context__np_geoname_id", "context", (GEO,)),
        Rule("rule__context__np_subdivision", "context", (REGION,)),
        Rule("rule__context__rt_geoid", "context", (Part("rt", "geoid", 2),)),
        Rule("rule__context__rt_geoname", "context", (Part("rt", "geoname", 2),)),
        Rule("rule__identity_rescue__phone_digits", "identity_rescue", (Part("identity", "phone", 7),)),
        Rule("rule__identity_rescue__phone_prefix6", "identity_rescue", (Part("identity", "phone", 6, "prefix6"),)),
        Rule("rule__coverage_fallback__email_hash_bucket_1024", "coverage_fallback", (Part("derived", "email_hash_bucket_1024"),)),
    ]
    out += [Rule(f"rule__behavior__fs_{f}", "behavior", (fs(f),)) for f in BEHAVIORS]
    window, cluster = "registration_time_window", "cluster_candidate"
    postman = tuple(fs(f"postman_{k}_90") for k in ("campaign", "action", "response"))
    out += [
        Rule(f"rule__{window}__np_geoname_id__registration_60m", window, (GEO, BUCKET)),
        Rule(f"rule__{window}__np_subdivision__np_device__np_osfamily__registration_60m", window, (REGION, DEVICE, OS, BUCKET)),
        Rule(f"rule__{cluster}__np_is_not_russia__np_device__np_osfamily__np_browser", cluster, (ABROAD, DEVICE, OS, BROWSER)),
        Rule(f"rule__{cluster}__fs_has_account__np_is_not_russia__np_device__np_osfamily__np_browser", cluster, (fs("has_account"), ABROAD, DEVICE, OS, BROWSER)),
        Rule(f"rule__{cluster}__fs_postman_campaign_90__fs_postman_action_90__fs_postman_response_90__np_device__np_osfamily", cluster, (*postman, DEVICE, OS)),
        Rule("rule__coverage__np_geoname_id__np_device__np_osfamily", "coverage_compound", (GEO, DEVICE, OS)),
        Rule("rule__coverage__np_geoname_id__np_device__np_osfamily__np_browser", "coverage_compound", (GEO, DEVICE, OS, BROWSER)),
        Rule("rule__coverage__np_subdivision__np_device__np_osfamily", "coverage_compound", (REGION, DEVICE, OS)),
        Rule("rule__coverage__email_domain__np_device__np_osfamily__sex", "coverage_compound", (DOMAIN, DEVICE, OS, Part("identity", "sex"))),
        Rule("rule__coverage__email_domain__email_initial2", "coverage_compound", (DOMAIN, Part("derived", "email_initial2"))),
    ]
    clicks = ("source_site_365", "has_click_365", "has_accept_365")
    for f in ("source_site_365", "has_account", "has_click_365", "has_accept_365", "visited_30"):
        out.append(Rule(f"rule__behavior_context__np_geoname_id__fs_{f}", "behavior_context", (GEO, fs(f))))
    for f in [f"postman_{k}_{days}" for days in (90, 30) for k in ("action", "campaign", "response")]:
        out.append(Rule(f"rule__postman_context__np_geoname_id__fs_{f}", "postman_context", (GEO, fs(f))))
    for f in clicks:
        out.append(Rule(f"rule__behavior_context_device__np_subdivision__fs_{f}__np_osfamily", "behavior_context_device", (REGION, fs(f), OS)))
        out.append(Rule(f"rule__behavior_daypart__np_geoname_id__fs_{f}__rt_daypart__rt_weekpart", "behavior_daypart", (GEO, fs(f), HOUR, DAY)))
        out.append(Rule(f"rule__{window}__np_geoname_id__fs_{f}__registration_60m", window, (GEO, fs(f), BUCKET)))
    for f in clicks[:2]:
        name = f"rule__behavior_daypart_device__np_subdivision__fs_{f}__np_osfamily__rt_daypart__rt_weekpart"
        out.append(Rule(name, "behavior_daypart_device", (REGION, fs(f), OS, HOUR, DAY)))
    return out


def recommended() -> list[Rule]:
    return [r for r in catalogue() if r.name not in NOT_RECOMMENDED]


def named(names: Iterable[str]) -> list[Rule]:
    """Rules by name: the allow-list is applied here, so that other rules are never planned."""
    wanted = set(names)
    return [r for r in catalogue() if r.name in wanted]
