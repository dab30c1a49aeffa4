"""Folders of the given tables."""

SF_0001 = "/root/testdata/sf0.001"
SF_001 = "/root/testdata/sf0.01"
