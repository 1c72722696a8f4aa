"""Resumable work: append sinks that skip what is done, and stages that run only where their results aren't valid."""
