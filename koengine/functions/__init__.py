"""koengine.functions"""
