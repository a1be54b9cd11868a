"""State events for notification: built from states and objects, with relations attached in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

RELATIONS = ("host", "services", "hostgroups", "servicegroups", "vars", "object.type")


def groups_of(members: DataFrame, groups: DataFrame, key: str, group_key: str) -> DataFrame:
    """(key, name, display_name), distinct."""
    own = groups.select(F.col("id").alias(group_key), "name", "display_name")
    return members.join(own, group_key).select(key, "name", "display_name").distinct()


def servicegroups_of_hosts(members: DataFrame, services: DataFrame, groups: DataFrame) -> DataFrame:
    """(host_id, name, display_name): the groups of all services of a host, distinct."""
    hosted = members.join(services.select(F.col("id").alias("service_id"), "host_id"), "service_id")
    return groups_of(hosted, groups, "host_id", "servicegroup_id")


def services_of_hosts(services: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host_id, id, name, display_name) of the services of some hosts."""
    return services.join(hosts.select(F.col("id").alias("host_id")).distinct(), "host_id", "left_semi").select("host_id", "id", "name", "display_name")


def named_list(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): sorted distinct (name, display_name) of each key."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("name", "display_name"))).alias(name))


def build_state_events(states: DataFrame, objects: DataFrame, base_url: str = "/monitoring") -> tuple[DataFrame, DataFrame]:
    """(events, rejected). states: object_type, host_id, service_id, environment_id, hard_state, previous_hard_state, state_type,
    output, long_output, in_downtime, is_acknowledged, is_flapping; objects: host_id, service_id, host_name, host_display_name,
    service_name, service_display_name, is_volatile (service parts null for hosts).

    Pending states and the first ok after them are left out, as are soft states of objects that are not volatile. States
    without a severity are rejected.
    """
    live = states.filter(~S.ignorable("hard_state", "previous_hard_state"))
    same = live["host_id"].eqNullSafe(objects["host_id"]) & live["service_id"].eqNullSafe(objects["service_id"])
    found = live.join(objects, same).drop(objects["host_id"]).drop(objects["service_id"]).filter(S.counts_as_hard("state_type", "is_volatile"))
    found = found.withColumn("severity", S.severity("object_type", "hard_state"))
    flags = ("in_downtime", "is_acknowledged", "is_flapping")
    is_muted = S.muted(*flags)
    events = found.filter("severity is not null").select(
        "environment_id", "object_type", "host_id", "service_id", "host_name", "service_name", "hard_state", "previous_hard_state",
        S.event_name("host_display_name", "service_display_name").alias("name"), S.event_url(base_url, "host_name", "service_name").alias("url"),
        S.event_tags("host_name", "service_name", "environment_id").alias("tags"), S.message("output", "long_output").alias("message"), "severity",
        is_muted.alias("muted"), S.muted_reason(*flags).alias("muted_reason"), F.lit(True).alias("incident"),
        S.close_flag("severity", is_muted).alias("close"), S.notify_flag("severity", is_muted, "hard_state", "previous_hard_state").alias("notify"),
    )
    return events, found.filter("severity is null")


def incident_object_id(tags: str = "tags", environment: str = "environment_id"):  # noqa: ANN201
    """Id of the object that an incident's tags name: a host, or host!service."""
    t = F.col(tags)
    name = F.when(t["service"].isNull(), t["host"]).otherwise(F.concat(t["host"], F.lit("!"), t["service"]))
    return S.sha1_id(environment, name)


def enrich_events(
    events: DataFrame, services: DataFrame, hostgroups: DataFrame, servicegroups: DataFrame, servicegroups_of_host: DataFrame, host_vars: DataFrame, service_vars: DataFrame, relations: tuple[str, ...] = RELATIONS
) -> DataFrame:
    """events with `relations`, a JSON object of what was asked for; nulls are left out.

    services: id, host_id, name, display_name; groups: key (host_id or service_id), name, display_name; vars: key, vars (map).
    A service's event has that service only and its own groups, a host's all services of the host and all their groups.
    Relations are aggregated once per object that has events, and joined; those of other objects are dropped before that.
    """
    if unknown := set(relations) - set(RELATIONS):
        raise ValueError(f"unknown relations: {sorted(unknown)}")
    out = events
    hosts, own_services = (events.select(c).filter(F.col(c).isNotNull()).distinct() for c in ("host_id", "service_id"))
    known = services.join(own_services.withColumnRenamed("service_id", "id"), "id", "left_semi")
    services, hostgroups, servicegroups_of_host, host_vars = (df.join(hosts, "host_id", "left_semi") for df in (services, hostgroups, servicegroups_of_host, host_vars))
    servicegroups, service_vars = (df.join(own_services, "service_id", "left_semi") for df in (servicegroups, service_vars))
    all_services = named_list(services, "host_id", "__host_services")
    own_service = known.select(F.col("id").alias("service_id"), F.array(F.struct("name", "display_name")).alias("__own_service"))
    parts: dict[str, object] = {}
    if "host" in relations:
        parts["host"] = F.struct(F.col("host_name").alias("name"))
    if "services" in relations:
        out = out.join(all_services, "host_id", "left").join(own_service, "service_id", "left")
        parts["services"] = F.when(F.col("service_id").isNull(), F.col("__host_services")).otherwise(F.col("__own_service"))
    if "hostgroups" in relations:
        out = out.join(named_list(hostgroups, "host_id", "__hg"), "host_id", "left")
        parts["hostgroups"] = F.col("__hg")
    if "servicegroups" in relations:
        out = out.join(named_list(servicegroups, "service_id", "__sg"), "service_id", "left").join(named_list(servicegroups_of_host, "host_id", "__hsg"), "host_id", "left")
        parts["servicegroups"] = F.when(F.col("service_id").isNull(), F.col("__hsg")).otherwise(F.col("__sg"))
    if "vars" in relations:
        out = out.join(host_vars.withColumnRenamed("vars", "__hv"), "host_id", "left").join(service_vars.withColumnRenamed("vars", "__sv"), "service_id", "left")
        parts["vars"] = F.struct(F.col("__hv").alias("host"), F.when(F.col("service_id").isNotNull(), F.col("__sv")).alias("service"))
    if "object.type" in relations:
        parts["object"] = F.struct(F.col("object_type").alias("type"))
    body = F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()]))
    return out.select(*events.columns, body.alias("relations"))
