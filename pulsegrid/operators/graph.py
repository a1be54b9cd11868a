"""Dependencies between checkables: lookups and audits over nodes and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def invalid_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that are not just one of a checkable and a redundancy group."""
    return nodes.filter(F.col("host_id").isNotNull() == F.col("redundancy_group_id").isNotNull())


def parents_of(edges: DataFrame, nodes: DataFrame, hosts: DataFrame, groups: DataFrame) -> DataFrame:
    """(child, parent_host, parent_group) of every host that has parents."""
    child = nodes.select(F.col("id").alias("from_node_id"), F.col("host_id").alias("child_id")).join(hosts.select(F.col("id").alias("child_id"), F.col("name").alias("child")), "child_id")
    parent = nodes.select(F.col("id").alias("to_node_id"), F.col("host_id").alias("parent_id"), F.col("redundancy_group_id").alias("group_id"))
    parent = parent.join(hosts.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_host")), "parent_id", "left")
    parent = parent.join(groups.select(F.col("id").alias("group_id"), F.col("display_name").alias("parent_group")), "group_id", "left")
    return edges.select("from_node_id", "to_node_id").join(child, "from_node_id").join(parent, "to_node_id").select("child", "parent_host", "parent_group")


def redundancy_groups_of(children: DataFrame, edges: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """The distinct redundancy groups that some children (name) depend on: id, display_name. children: host ids as `id`."""
    own = nodes.join(children.select(F.col("id").alias("host_id")), "host_id", "left_semi").select(F.col("id").alias("from_node_id"))
    to = edges.join(own, "from_node_id", "left_semi").select(F.col("to_node_id").alias("id")).join(nodes, "id").select(F.col("redundancy_group_id").alias("id")).filter("id is not null").distinct()
    return groups.join(to, "id", "left_semi").select("id", "display_name")


def dangling(nodes: DataFrame, edges: DataFrame, hosts: DataFrame, services: DataFrame, groups: DataFrame, edge_states: DataFrame) -> DataFrame:
    """(check, id, missing): references of nodes and edges that lead nowhere."""

    def check(name: str, df: DataFrame, column: str, target: DataFrame) -> DataFrame:
        own = df.select(F.lit(name).alias("check"), "id", F.col(column).alias("missing")).filter("missing is not null")
        return own.join(target.select(F.col("id").alias("missing")), "missing", "left_anti").select("check", "id", "missing")

    return reduce(
        DataFrame.unionByName,
        [
            check("node_host", nodes, "host_id", hosts), check("node_service", nodes, "service_id", services), check("node_group", nodes, "redundancy_group_id", groups),
            check("edge_from", edges, "from_node_id", nodes), check("edge_to", edges, "to_node_id", nodes), check("edge_state", edges, "dependency_edge_state_id", edge_states),
        ],
    )


def recipients(notifications: DataFrame, recipients: DataFrame, users: DataFrame, groups: DataFrame) -> DataFrame:
    """(notification, user, usergroup) of each recipient; the part that it lacks is null and sorts first."""
    named = notifications.select(F.col("id").alias("notification_id"), F.col("name").alias("notification"))
    out = named.join(recipients, "notification_id").join(users.select(F.col("id").alias("user_id"), F.col("name").alias("user")), "user_id", "left")
    out = out.join(groups.select(F.col("id").alias("usergroup_id"), F.col("name").alias("usergroup")), "usergroup_id", "left")
    return out.select("notification", "user", "usergroup").orderBy("notification", F.col("user").asc_nulls_first(), F.col("usergroup").asc_nulls_first())
