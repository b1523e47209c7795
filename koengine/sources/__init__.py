"""koengine.sources"""
