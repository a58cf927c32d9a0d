"""Schemas of the domain tables, as Spark DDL."""

from __future__ import annotations

POINTS = "pid long, id string, ts timestamp, lon double, lat double, heading double, speed double, zone string, road long, type string, country string"
CARS_LOG = "id string, latitude string, longitude string, heading string, speed string, ts string"
TAG = "array<struct<_k:string,_v:string>>"
OSM_NODE = f"_id long, _lat double, _lon double, _version int, _changeset long, _uid long, _user string, _timestamp string, tag {TAG}"
OSM_WAY = f"_id long, _version int, _changeset long, _uid long, _user string, _timestamp string, nd array<struct<_ref:long>>, tag {TAG}"
OSM_RELATION = f"_id long, _version int, _changeset long, _uid long, _user string, _timestamp string, member array<struct<_type:string,_ref:long,_role:string>>, tag {TAG}"
ZONES = "zone string, dept string, ring array<struct<lon:double,lat:double>>"
SPEED_LONG = "segment string, ts timestamp, speed double, cnt long"
MERGE_MAP = "segment string, grp string"
PREDICTIONS = "model string, segment string, ts timestamp, y double, pred double"
