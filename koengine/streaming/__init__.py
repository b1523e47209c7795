"""koengine.streaming"""
