"""koengine.operators"""
