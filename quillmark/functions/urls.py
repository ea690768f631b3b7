"""Addresses of videos and channels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts that are resolved.
HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "youtu.be", "www.youtu.be")
SHORT = ("youtu.be", "www.youtu.be")


def resolved(url: Column) -> dict[str, Column]:
    """``kind`` (video, channel), ``id_kind`` (id, handle, user), ``id`` and canonical ``link``; all null for any other address.

    Only plain http and https addresses of the known hosts, without user, password
    or port, up to 2,048 characters.
    """
    u = F.trim(url)
    ok = (F.length(u) <= 2048) & u.rlike(r"(?i)^https?://[^/?#@:]+(?:[/?#]|$)")
    host = F.lower(F.regexp_extract(u, r"^\w+://([^/?#]+)", 1))
    path = F.filter(F.split(F.regexp_extract(u, r"^\w+://[^/?#]+([^?#]*)", 1), "/"), lambda x: x != "")
    part = lambda i: F.coalesce(F.get(path, F.lit(i)), F.lit(""))
    v = F.regexp_extract(F.regexp_extract(u, r"\?([^#]*)", 1), r"(?:^|&)v=([^&]*)", 1)
    short = host.isin(*SHORT)
    raw = F.when(short & (F.size(path) == 1), part(0)).when(short, "").when(part(0) == "watch", v).when(part(0).isin("shorts", "live", "embed"), part(1)).otherwise("")
    video = raw.rlike(r"^[A-Za-z0-9_-]{11}$")
    free = raw == ""
    handle = free & ~short & part(0).rlike(r"^@[^\s/?#%]+$")
    channel = free & ~short & (part(0) == "channel") & part(1).rlike(r"^UC[A-Za-z0-9_-]{22}$")
    user = free & ~short & (part(0) == "user") & part(1).rlike(r"^[A-Za-z0-9_.-]{1,100}$")
    known = ok & host.isin(*HOSTS)
    kind = F.when(known & video, "video").when(known & (handle | channel | user), "channel")
    name = F.when(known & video, raw).when(known & handle, part(0)).when(known & (channel | user), part(1))
    how = F.when(known & (video | channel), "id").when(known & handle, "handle").when(known & user, "user")
    base = "https://www.youtube.com/"
    link = F.when(known & video, F.concat(F.lit(base + "watch?v="), raw)).when(known & handle, F.concat(F.lit(base), part(0))).when(known & channel, F.concat(F.lit(base + "channel/"), part(1))).when(known & user, F.concat(F.lit(base + "user/"), part(1)))
    return {"kind": kind, "id_kind": how, "id": name, "link": link}


def permalink(video: Column, comment: Column) -> Column:
    """Address of one comment of a video."""
    return F.concat(F.lit("https://www.youtube.com/watch?v="), video, F.lit("&lc="), F.url_encode(comment))
