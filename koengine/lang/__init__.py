"""Query language: text and JSON front ends for the logical plan."""
